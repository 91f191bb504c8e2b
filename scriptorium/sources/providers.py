"""Pluggable providers of journal metadata and of completions; offline by default."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F


class Lookup(Protocol):
    """Answers a key (DOI, ISSN or ISBN) with (publisher, journal), or None."""

    def __call__(self, key: str) -> tuple[str | None, str | None] | None: ...


class Completer(Protocol):
    """Answers a prompt with text."""

    def __call__(self, prompt: str) -> str: ...


def retry_delay(attempt: int, status: int | None, headers: dict[str, str] | None = None, base: float = 1.5) -> float:
    """Seconds to wait: what the answer says, else exponential from 10 s at status 429, else in proportion to the attempt."""
    stated = {k.lower(): v for k, v in (headers or {}).items()}
    for key, unit in (("retry-after-ms", 1000.0), ("retry-after", 1.0)):
        try:
            return max(0.0, float(stated[key]) / unit)
        except (KeyError, ValueError):
            continue
    return max(10.0, base * 2**attempt) if status == 429 else base * (attempt + 1)


class ProviderError(OSError):
    """A refusal of a provider, with the status and headers that say how long to wait."""

    def __init__(self, message: str, status: int | None = None, headers: dict[str, str] | None = None) -> None:
        super().__init__(message)
        self.status, self.headers = status, headers


def with_retries(call: Callable[[], str], retries: int = 3, base: float = 1.5, sleep: Callable[[float], None] | None = None) -> str:
    """Result of ``call``, tried again after transient errors (``OSError``), others pass at once; a refusal says how long to wait."""
    import time

    for attempt in range(retries + 1):
        try:
            return call()
        except OSError as e:
            if attempt == retries:
                raise
            (sleep or time.sleep)(retry_delay(attempt, getattr(e, "status", None), getattr(e, "headers", None), base=base))
    raise AssertionError


def calls_at_once(rows: DataFrame, partitions: int | None) -> int:
    """How many tasks ask a provider at one time: what is given, else the session's shuffle partitions. A provider limits its own calls."""
    return partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def static_lookup(spark: SparkSession, answers: dict[str, tuple[str | None, str | None]], provider: str = "crossref") -> DataFrame:
    """Offline provider: a table of answers."""
    return spark.createDataFrame([(provider, k.lower(), p, j) for k, (p, j) in answers.items()], "provider string, key string, publisher string, journal string")


def ask_lookup(keys: DataFrame, lookup: Lookup, provider: str, partitions: int | None = None) -> DataFrame:
    """``provider, key, publisher, journal`` of distinct ``keys`` of one provider; ``partitions`` bounds the calls at one time."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, *answer) for k in b.column(0).to_pylist() if (answer := with_retries(lambda k=k: lookup(k)))]
            columns = [pa.array([r[i] for r in rows], pa.string()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array([provider] * len(rows), pa.string()), *columns], names=["provider", "key", "publisher", "journal"])

    mine = keys.filter(F.col("provider") == provider) if "provider" in keys.columns else keys
    return mine.select("key").distinct().repartition(calls_at_once(keys, partitions)).mapInArrow(ask, "provider string, key string, publisher string, journal string")
