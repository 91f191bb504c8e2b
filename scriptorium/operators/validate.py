"""Validation rules over records: one wide native projection, one anti-join for each reference set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scriptorium.functions import text as X

TEXT_FIELDS = ("dc_title", "dc_description_abstract", "dc_contributor_author", "utb_wos_affiliation", "utb_scopus_affiliation", "dc_publisher", "dc_relation_ispartof")
URL_FIELDS = ("dc_identifier_uri",)
PIPE_FIELDS = ("utb_wos_affiliation", "utb_scopus_affiliation")

#: Rule on one text to the test of a text.
TEXT_RULES = {
    "trailing_spaces": X.has_outer_space,
    "mojibake": X.has_mojibake,
    "encoding_chars": X.has_encoding_chars,
    "standalone_diacritics": X.has_standalone_diacritics,
    "nbsp": X.has_nbsp,
    "double_space": X.has_double_space,
}


def _any(col: Column, test) -> Column:
    return F.coalesce(F.exists(col, test), F.lit(False))


def validation_issues(records: DataFrame, registry_names: DataFrame | None = None, *, text_fields: tuple[str, ...] = TEXT_FIELDS) -> DataFrame:
    """``resource_id, issues, status``: rule to the fields that break it; status ``ok`` or ``has_issues``.

    Null fields and elements break no rule; an empty table gives an empty one; repeated rows give repeated results; other
    columns are ignored. ``registry_names`` (``name``) is compared character by character with internal authors.
    """
    have = [f for f in text_fields if f in records.columns]
    lists = {}
    for rule, test in TEXT_RULES.items():
        lists[rule] = F.array_compact(F.array(*[F.when(_any(F.col(f), test), F.lit(f)) for f in have]))
    lists["pipe_in_field"] = F.array_compact(F.array(*[F.when(_any(F.col(f), lambda x: x.contains("|")), F.lit(f)) for f in PIPE_FIELDS if f in have]))
    lists["invalid_doi"] = F.filter("dc_identifier_doi", lambda d: ~X.is_doi(d))
    lists["brackets_in_title"] = F.filter("dc_title", lambda t: t.rlike(r"\[.+\]"))
    lists["invalid_wos_id"] = F.filter("utb_identifier_wok", lambda w: (X.utrim(w) != "") & ~X.utrim(w).startswith("0"))
    names = F.transform(F.coalesce("dc_contributor_author", F.array().cast("array<string>")), X.normalise)
    lists["internal_not_in_authors"] = F.filter("utb_contributor_internalauthor", lambda a: ~F.array_contains(F.coalesce(names, F.array().cast("array<string>")), X.normalise(a)))
    rows = records
    if registry_names is not None:
        inner = records.select("resource_id", F.explode("utb_contributor_internalauthor").alias("name"))
        unknown = inner.join(registry_names.select("name").distinct(), "name", "left_anti").groupBy("resource_id").agg(F.array_sort(F.collect_set("name")).alias("__unknown"))
        rows = records.join(unknown, "resource_id", "left")
        lists["authors_not_in_registry"] = F.col("__unknown")
    pairs = F.array(*[F.struct(F.lit(k).alias("rule"), F.coalesce(v, F.array().cast("array<string>")).alias("fields")) for k, v in lists.items()])
    issues = F.map_from_entries(F.filter(pairs, lambda p: F.size(p["fields"]) > 0))
    out = rows.select("resource_id", issues.alias("issues"))
    return out.withColumn("status", F.when(F.size("issues") > 0, "has_issues").otherwise("ok"))


def suggested_fixes(records: DataFrame, *, text_fields: tuple[str, ...] = TEXT_FIELDS) -> DataFrame:
    """``resource_id, field_name, original, suggested, fix_type`` of every field with a proposed fix.

    A DOI that becomes valid replaces the text fix of its field. Fix types are sorted and joined by a plus sign.
    """
    have = [f for f in text_fields if f in records.columns]
    rows = []
    for f in have:
        fixed = F.transform(F.col(f), lambda x: X.text_fixes(x)[0])
        kinds = F.array_compact(F.array(*[F.when(_any(F.col(f), (lambda k: lambda x: dict(X.text_fixes(x)[1])[k])(kind)), F.lit(kind)) for kind in ("double_space", "encoding_chars", "mojibake", "nbsp", "standalone_diacritics", "trailing_spaces")]))
        rows.append(F.struct(F.lit(f).alias("field_name"), F.col(f).alias("original"), fixed.alias("suggested"), F.array_join(kinds, "+").alias("fix_type")))
    doi = F.transform("dc_identifier_doi", X.clean_doi)
    mended = F.exists(F.arrays_zip(F.col("dc_identifier_doi").alias("a"), doi.alias("b")), lambda p: ~X.is_doi(p["a"]) & p["b"].rlike(X.DOI_FORM))
    rows.append(F.struct(F.lit("dc_identifier_doi").alias("field_name"), F.col("dc_identifier_doi").alias("original"), F.when(mended, doi).otherwise(F.col("dc_identifier_doi")).alias("suggested"), F.lit("doi").alias("fix_type")))
    for f in (f for f in URL_FIELDS if f in records.columns):  # a fix without an issue
        rows.append(F.struct(F.lit(f).alias("field_name"), F.col(f).alias("original"), F.transform(F.col(f), X.clean_url).alias("suggested"), F.lit("url_query").alias("fix_type")))
    flat = records.select("resource_id", F.inline(F.array(*rows)))
    return flat.filter(F.col("original").isNotNull() & (F.col("original") != F.col("suggested")))


def apply_fixes(records: DataFrame, fixes: DataFrame) -> DataFrame:
    """New version of ``records`` with the suggested values of ``fixes``."""
    fields = [f for f in (*TEXT_FIELDS, "dc_identifier_doi", *URL_FIELDS) if f in records.columns]
    by = fixes.groupBy("resource_id").pivot("field_name", fields).agg(F.first("suggested"))
    by = by.select("resource_id", *[F.col(f).alias(f"__{f}") for f in fields])
    out = records.join(by, "resource_id", "left")
    return out.withColumns({f: F.coalesce(F.col(f"__{f}"), F.col(f)) for f in fields}).select(*records.columns)


def after_fixes(issues: DataFrame, fixes: DataFrame) -> DataFrame:
    """``issues`` with status ``not_checked`` and no issues for the records that ``fixes`` changed: they are to be looked at again."""
    mark = fixes.select("resource_id").distinct().withColumn("__f", F.lit(True))
    rows = issues.join(mark, "resource_id", "left")
    fixed = F.coalesce("__f", F.lit(False))
    return rows.select("resource_id", F.when(~fixed, F.col("issues")).alias("issues"), F.when(fixed, "not_checked").otherwise(F.col("status")).alias("status"))


def missing_ids(records: DataFrame, known: DataFrame, *, column: str = "utb_identifier_obdid", key: str = "id") -> DataFrame:
    """``resource_id, missing``: identifiers of a record that ``known`` hasn't, sorted."""
    ids = records.select("resource_id", F.explode(column).alias("x")).filter(F.trim("x") != "")
    keys = known.select(F.col(key).cast("string").alias("x")).distinct()
    return ids.join(keys, "x", "left_anti").groupBy("resource_id").agg(F.array_sort(F.collect_set("x")).alias("missing"))


def issue_counts(issues: DataFrame) -> DataFrame:
    """``rule, n``: records that break each rule."""
    return issues.select(F.explode(F.map_keys("issues")).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


def status_counts(rows: DataFrame, column: str = "status") -> DataFrame:
    """Histogram of a status column."""
    return rows.groupBy(column).agg(F.count("*").alias("n"))
