"""Milestone dates of records."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scriptorium.functions.fulltext_dates import MILESTONES, extract

_SCHEMA = pa.schema([
    ("resource_id", pa.int64()), *[(m, pa.date32()) for m in MILESTONES], ("status", pa.string()), ("needs_llm", pa.bool_()),
    ("mdr_format", pa.string()), ("mdr_confidence", pa.string()), ("flag_keys", pa.list_(pa.string())),
])
_DDL = "resource_id bigint, " + ", ".join(f"{m} date" for m in MILESTONES) + ", status string, needs_llm boolean, mdr_format string, mdr_confidence string, flag_keys array<string>"


def extract_dates(records: DataFrame, column: str = "utb_fulltext_dates", backward_error: int = 30) -> DataFrame:
    """One row for each record with a text of dates: milestones, status, order of day and month, flags.

    The elements of an array are joined by blanks. Null and empty fields give status ``empty``; repeated rows give repeated
    results; an empty table an empty one; a text that breaks the parser gives status ``error``.
    """
    kind = dict(records.dtypes)[column]
    text = F.array_join(F.col(column), " ") if kind.startswith("array") else F.col(column)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for rid, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    rows.append({"resource_id": rid, **extract(raw, backward_error)})
                except Exception:  # noqa: BLE001 - one bad text must not end the job
                    rows.append({"resource_id": rid, "status": "error", "needs_llm": True})
            yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    return records.select(F.col("resource_id").cast("bigint"), text.alias("raw")).mapInArrow(read, _DDL)


def date_status(dates: DataFrame) -> DataFrame:
    """``status, n, n_received, n_accepted, n_published, n_needs_llm``."""
    return dates.groupBy("status").agg(
        F.count("*").alias("n"), F.count("received").alias("n_received"), F.count("accepted").alias("n_accepted"),
        F.count("published").alias("n_published"), F.sum(F.when(F.col("needs_llm"), 1).otherwise(0)).alias("n_needs_llm"),
    )
