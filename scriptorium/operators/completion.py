"""Fallback of the heuristics through a completer: prompts, answers checked against a contract, results laid over."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scriptorium.functions.fulltext_dates import MILESTONES
from scriptorium.functions.similarity import jaro_winkler
from scriptorium.sources.providers import Completer, calls_at_once, with_retries

FIRST_YEAR, LAST_YEAR = 1990, 2035


def salvage_json(raw: str) -> dict:
    """Object in an answer: fences and text around it dropped; raises ValueError if there is none."""
    text = re.sub(r"```(?:json)?", "", raw or "")
    start, end = text.find("{"), text.rfind("}")
    if start < 0 or end < start:
        raise ValueError("no object in the answer")
    found = json.loads(text[start : end + 1])
    if not isinstance(found, dict):
        raise ValueError("the answer is no object")
    return found


def check_dates(answer: dict, source: str = "") -> dict[str, str]:
    """ISO date or empty text of each milestone; unknown keys are an error; a year alone read as its first day is emptied."""
    if unknown := set(answer) - set(MILESTONES):
        raise ValueError(f"unknown keys {sorted(unknown)}")
    out = {}
    for k in MILESTONES:
        text = str(answer.get(k) or "").strip()
        try:
            ok = FIRST_YEAR <= date.fromisoformat(text).year <= LAST_YEAR
        except ValueError:
            ok = False
        bare = text.endswith("-01-01") and not re.search(r"\b0?1[.\-/ ]|jan", source, re.IGNORECASE)
        out[k] = text if ok and not (bare and source) else ""
    return out


def check_authors(answer: dict, allowed: dict[str, str], faculties: dict[str, str], units: list[str], snap: float = 0.92) -> list[dict[str, str]]:
    """Authors of an answer that are allowed, each person once under the preferred name; workplaces outside the lists emptied.

    ``allowed``: plain name to preferred name; ``faculties``: any spelling to the canonical one; a unit is snapped to the
    most similar of ``units`` from ``snap`` on.
    """
    out: list[dict[str, str]] = []
    seen = set()
    for a in answer.get("authors", []):
        if extra := set(a) - {"name", "faculty", "ou"}:
            raise ValueError(f"unknown keys {sorted(extra)}")
        name = str(a.get("name") or "").strip()
        if len(name) < 3:
            raise ValueError("a name has at least three characters")
        preferred = allowed.get(" ".join(name.lower().split()))
        if preferred is None or preferred in seen:
            continue
        seen.add(preferred)
        unit = str(a.get("ou") or "").strip()
        best = max(units, key=lambda u: jaro_winkler(u.lower(), unit.lower()), default="")
        out.append({"name": preferred, "faculty": faculties.get(str(a.get("faculty") or "").strip(), ""), "ou": best if unit and jaro_winkler(best.lower(), unit.lower()) >= snap else ""})
    return out


def date_prompt(rows: DataFrame, text: str = "raw") -> DataFrame:
    """``rows`` with ``prompt`` for the milestone dates."""
    head = "Return a JSON object with the keys " + ", ".join(MILESTONES) + "; ISO dates, or empty where the text has none."
    return rows.withColumn("prompt", F.concat_ws("\n", F.lit(head), F.concat(F.lit("Record "), F.col("resource_id").cast("string")), F.col(text)))


def complete_dates(rows: DataFrame, completer: Completer, *, partitions: int | None = None, retries: int = 1) -> DataFrame:
    """``resource_id, status, <milestones>, error`` of rows with a ``prompt`` and ``raw``; a breach of the contract isn't tried again."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for rid, prompt, raw in zip(*(b.column(i).to_pylist() for i in range(3))):
                try:
                    found = check_dates(salvage_json(with_retries(lambda p=prompt: completer(p), retries, 0.0)), raw or "")
                    made.append({"resource_id": rid, "status": "processed", **found})
                except ValueError as e:
                    made.append({"resource_id": rid, "status": "validation_error", "error": str(e)[:200]})
                except OSError as e:
                    made.append({"resource_id": rid, "status": "error", "error": str(e)[:200]})
            yield pa.RecordBatch.from_pylist(made, schema=pa.schema([("resource_id", pa.int64()), ("status", pa.string()), *[(m, pa.string()) for m in MILESTONES], ("error", pa.string())]))

    ddl = "resource_id bigint, status string, " + ", ".join(f"{m} string" for m in MILESTONES) + ", error string"
    return rows.select(F.col("resource_id").cast("bigint"), "prompt", "raw").repartition(calls_at_once(rows, partitions)).mapInArrow(ask, ddl)


def author_prompt(rows: DataFrame) -> DataFrame:
    """``rows`` (``resource_id, names, affiliations, candidates`` as arrays) with ``prompt`` for authors and workplaces."""
    head = "Return a JSON object with the key authors: a list of objects with name, faculty and ou. Use only the candidates."
    line = lambda title, c: F.concat(F.lit(title), F.array_join(c, "; "))
    return rows.withColumn("prompt", F.concat_ws("\n", F.lit(head), F.concat(F.lit("Record "), F.col("resource_id").cast("string")), line("Authors: ", "names"), line("Affiliations: ", "affiliations"), line("Candidates: ", "candidates")))


def complete_authors(rows: DataFrame, completer: Completer, faculties: dict[str, str], units: list[str], *, partitions: int | None = None, retries: int = 1) -> DataFrame:
    """``resource_id, status, names, faculties, ous, error`` (aligned arrays) of rows with a ``prompt`` and ``candidates``."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for rid, prompt, candidates in zip(*(b.column(i).to_pylist() for i in range(3))):
                allowed = {" ".join(c.lower().split()): c for c in candidates or ()}
                try:
                    found = check_authors(salvage_json(with_retries(lambda p=prompt: completer(p), retries, 0.0)), allowed, faculties, units)
                    made.append({"resource_id": rid, "status": "processed", **{k: [a[f] for a in found] for k, f in (("names", "name"), ("faculties", "faculty"), ("ous", "ou"))}})
                except ValueError as e:
                    made.append({"resource_id": rid, "status": "validation_error", "error": str(e)[:200]})
                except OSError as e:
                    made.append({"resource_id": rid, "status": "error", "error": str(e)[:200]})
            listed = pa.list_(pa.string())
            yield pa.RecordBatch.from_pylist(made, schema=pa.schema([("resource_id", pa.int64()), ("status", pa.string()), ("names", listed), ("faculties", listed), ("ous", listed), ("error", pa.string())]))

    ddl = "resource_id bigint, status string, names array<string>, faculties array<string>, ous array<string>, error string"
    return rows.select(F.col("resource_id").cast("bigint"), "prompt", "candidates").repartition(calls_at_once(rows, partitions)).mapInArrow(ask, ddl)


def lay_over(heuristic: DataFrame, completed: DataFrame) -> DataFrame:
    """Milestones of ``completed`` where it has them, else those of the heuristic."""
    c = completed.select("resource_id", *[F.col(m).alias(f"__{m}") for m in MILESTONES])
    out = heuristic.join(c, "resource_id", "left")
    return out.withColumns({m: F.coalesce(F.nullif(F.col(f"__{m}"), F.lit("")).try_cast("date"), F.col(m)) for m in MILESTONES}).select(*heuristic.columns)
