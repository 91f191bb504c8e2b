"""Bootstrapping, immutable stage outputs and their latest version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def bootstrap(source: DataFrame, path: str, *, key: str = "resource_id", mode: str = "ignore", limit: int | None = None) -> DataFrame:
    """Copy of ``source`` with one row for each key; ``mode`` overwrite or ignore; ``limit`` rows in order of the key."""
    rows = source.dropDuplicates([key])
    rows = rows.orderBy(key).limit(limit) if limit else rows
    rows.write.mode(mode).parquet(path)
    return source.sparkSession.read.parquet(path)


def missing_rows(main: DataFrame, queue: DataFrame, defaults: dict[str, object], key: str = "resource_id") -> DataFrame:
    """Rows of keys that ``queue`` hasn't yet, with default values."""
    return main.select(key).distinct().join(queue.select(key).distinct(), key, "left_anti").withColumns({k: F.lit(v) for k, v in defaults.items()})


def due(records: DataFrame, queue: DataFrame, column: str, statuses: list[str], *, limit: int | None = None, again: bool = False, key: str = "resource_id") -> DataFrame:
    """Records whose ``column`` of the queue is one of ``statuses``, all of the queue if ``again``; at most ``limit`` in order of the key.

    Each record is due once; records that the queue hasn't are not.
    """
    chosen = queue if again else queue.filter(F.col(column).isin(statuses))
    rows = records.join(chosen.select(key).distinct(), key, "left_semi")
    return rows.orderBy(key).limit(limit) if limit else rows


def fetch(records: DataFrame, ids: DataFrame, key: str = "resource_id") -> DataFrame:
    """Records of a batch of ids, each once."""
    return records.join(ids.select(key).distinct(), key, "left_semi")


def page(rows: DataFrame, limit: int, key: str = "resource_id", most: int = 500) -> DataFrame:
    """First rows by key; a page has 1 to ``most`` rows, whatever is asked for."""
    return rows.orderBy(key).limit(max(1, min(limit, most)))


def valid_units(units: DataFrame, on: str, column: str = "valid_to") -> DataFrame:
    """Units that are valid on a day: without an end or with a later one."""
    return units.filter(F.col(column).isNull() | (F.col(column) > F.lit(on).cast("date")))


# What the history says of a merge besides the record itself.
AUDIT_COLUMNS = {
    "dedup_merged_at": "timestamp", "dedup_match_type": "string", "dedup_match_score": "double", "dedup_match_details": "string", "dedup_kept_resource_id": "bigint", "dedup_other_resource_id": "bigint",
}


def with_audit(history: DataFrame) -> DataFrame:
    """``history`` with all audit columns, null where a merge left none."""
    return history.withColumns({c: F.col(c).cast(t) if c in history.columns else F.lit(None).cast(t) for c, t in AUDIT_COLUMNS.items()})


def orphans(main: DataFrame, queue: DataFrame, key: str = "resource_id") -> DataFrame:
    """Queue rows without a record."""
    return queue.join(main.select(key), key, "left_anti")


def with_columns(df: DataFrame, other: DataFrame) -> DataFrame:
    """Both tables' rows by name; columns that one lacks are null there."""
    return df.unionByName(other, allowMissingColumns=True)


def increments_view(spark: SparkSession, main: DataFrame, increments: DataFrame | None, name: str) -> DataFrame | None:
    """View of records and increments, all rows, columns by position; without increments nothing is made."""
    if increments is None:
        return None
    both = main.union(increments)
    both.createOrReplaceTempView(name)
    return both


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last row of each key by ``order``, without a sort."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("x")).select(*keys, "x.*")


def migrate_json(df: DataFrame, column: str) -> DataFrame:
    """``column`` as JSON text: what isn't JSON is wrapped as ``{"raw": ...}``, null is the empty object."""
    text = F.col(column)
    good = F.try_parse_json(text).isNotNull()
    return df.withColumn(column, F.when(text.isNull(), F.lit("{}")).when(good, text).otherwise(F.to_json(F.struct(text.alias("raw")))))


def array_literals(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns of array-literal text (``{a,"b c"}``) as arrays."""
    body = lambda c: F.regexp_extract(c, r"(?s)^\s*\{(.*)\}\s*$", 1)
    item = r'("(?:[^"\\]|\\.)*"|[^,"]+)'
    parse = lambda c: F.transform(F.regexp_extract_all(body(c), F.lit(item), 1), lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), r'^"|"$', ""), r"\\(.)", "$1"))
    return df.withColumns({c: F.when(F.col(c).rlike(r"^\s*\{"), F.filter(parse(F.col(c)), lambda x: x != "")).when(F.trim(c) != "", F.array(F.trim(c))) for c in columns})


def read_seed(spark: SparkSession, path: str, arrays: list[str] | None = None) -> DataFrame:
    """Semicolon-separated UTF-8 file with a header; a byte-order mark is dropped."""
    df = spark.read.csv(path, sep=";", header=True, encoding="UTF-8")
    df = df.toDF(*[c.lstrip("﻿").replace(".", "_") for c in df.columns])
    return array_literals(df, arrays) if arrays else df


# Older column names of the queue and their present names.
RENAMED = {
    "flags": "author_flags", "heuristic_status": "author_heuristic_status", "heuristic_version": "author_heuristic_version", "heuristic_processed_at": "author_heuristic_processed_at",
    "needs_llm": "author_needs_llm", "dc_contributor_author": "author_dc_names", "utb_contributor_internalauthor": "author_internal_names", "utb_faculty": "author_faculty",
    "utb_ou": "author_ou", "llm_result": "author_llm_result", "llm_status": "author_llm_status", "llm_processed_at": "author_llm_processed_at",
}


def rename_legacy(df: DataFrame, renamed: dict[str, str] | None = None) -> DataFrame:
    """``df`` with older column names replaced where the present one isn't there yet."""
    pairs = RENAMED if renamed is None else renamed
    return df.withColumnsRenamed({old: new for old, new in pairs.items() if old in df.columns and new not in df.columns})
