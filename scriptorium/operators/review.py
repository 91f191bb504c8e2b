"""Review lists, search, change buffer and overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from scriptorium.functions import text as X

# Endings of source tags of repository records.
REPOSITORY_ENDINGS = ("-riv", "-obd", "-orig")
# Orders of the record list.
SORTS = {
    "id": [("resource_id", True)], "id_desc": [("resource_id", False)], "title": [("title", True)], "title_desc": [("title", False)],
    "issued": [("issued", True)], "issued_desc": [("issued", False)],
}


def source_flags(records: DataFrame) -> DataFrame:
    """``resource_id, has_wos, has_scopus, has_repository``."""
    some = lambda words: F.coalesce(F.exists("utb_source", lambda s: _any(s, words)), F.lit(False))
    return records.select("resource_id", some(("wos", "wok")).alias("has_wos"), some(("scopus",)).alias("has_scopus"), some(("riv", "obd", "orig")).alias("has_repository"))


def _any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.lower(text).contains(w)
    return out


def list_groups(records: DataFrame) -> DataFrame:
    """``resource_id, list_group``: ``existing`` if a DOI, ISSN or ISBN is also in the repository, else ``duplicate`` if from WoS and Scopus, else ``single``.

    Pure repository rows and withdrawn ones are left out.
    """
    repository = F.exists("utb_source", lambda s: _ends(s))
    ids = lambda df: df.select("resource_id", F.explode(F.concat(*[F.transform(F.coalesce(c, F.array().cast("array<string>")), (lambda p: lambda x: F.concat(F.lit(p), F.lower(X.utrim(x))))(p)) for c, p in (("dc_identifier_doi", "d"), ("dc_identifier_issn", "s"), ("dc_identifier_isbn", "b"))])).alias("x")).filter(F.length("x") > 1)
    known = ids(records.filter(F.coalesce(repository, F.lit(False)))).select("x").distinct()
    shared = ids(records).join(known, "x", "left_semi").select("resource_id").distinct().withColumn("existing", F.lit(True))
    rows = records.filter(~F.coalesce("withdrawn", F.lit(False))).select("resource_id", "utb_source").join(source_flags(records), "resource_id")
    rows = rows.filter(~(F.col("has_repository") & ~F.col("has_wos") & ~F.col("has_scopus"))).join(shared, "resource_id", "left")
    group = F.when(F.coalesce("existing", F.lit(False)), "existing").when(F.col("has_wos") & F.col("has_scopus"), "duplicate").otherwise("single")
    return rows.select("resource_id", group.alias("list_group"))


def _ends(text: Column) -> Column:
    out = F.lit(False)
    for e in REPOSITORY_ENDINGS:
        out = out | F.lower(text).endswith(e)
    return out


def search(records: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """Records of which any searched field holds ``query`` (``%`` and ``_`` are wild cards), ordered by id; ``limit`` is the page size."""
    joined = lambda c: F.array_join(F.col(c), " ")
    fields = [F.col("resource_id").cast("string"), joined("dc_title"), joined("dc_contributor_author"), joined("dc_identifier_doi"), joined("dc_relation_ispartof"), F.try_element_at("dc_date_issued", F.lit(1)), F.concat_ws("/", "utb_relation_volume", "utb_relation_issue")]
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.coalesce(f.ilike(f"%{query}%"), F.lit(False))
    out = records.filter(hit & ~F.coalesce("withdrawn", F.lit(False))).select("resource_id", F.try_element_at("dc_title", F.lit(1)).alias("title"), F.try_element_at("dc_date_issued", F.lit(1)).alias("issued")).orderBy(F.asc_nulls_last("resource_id"))
    return out if not limit else out.limit(limit)


def relevance(rows: DataFrame, query: str, title: str, others: tuple[str, ...]) -> DataFrame:
    """``rows`` with ``score`` above 0: 2 for a hit in the title, 1 for each other field."""
    hit = lambda c: F.coalesce(F.lower(c).contains(query.lower()), F.lit(False))
    score = F.when(hit(F.col(title)), 2).otherwise(0)
    for o in others:
        score = score + F.when(hit(F.col(o)), 1).otherwise(0)
    return rows.withColumn("score", score).filter("score > 0")


def search_authors(registry: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Persons whose names hold ``query``, accents and case ignored."""
    text = X.normalise(F.concat_ws(" ", "display_name", "other_name", "faculty"))
    return registry.filter(text.contains(_plain(query))).select("author_id", "display_name").distinct().orderBy("author_id", "display_name").limit(limit)


def _plain(query: str) -> str:
    import unicodedata

    return "".join(ch for ch in unicodedata.normalize("NFD", query.lower()) if unicodedata.category(ch) != "Mn").strip()


def ordered(rows: DataFrame, sort: str = "id", group_key: str | None = None) -> DataFrame:
    """Rows in one of the list orders, nulls last, ties by id; with ``group_key`` members of a group stand together first."""
    keys = [F.asc_nulls_last(c) if up else F.desc_nulls_last(c) for c, up in SORTS[sort]]
    if group_key:
        keys = [F.coalesce(group_key, F.concat(F.lit("~"), F.col("resource_id").cast("string"))), *keys]
    return rows.orderBy(*keys, F.asc_nulls_last("resource_id"))


def pending_changes(events: DataFrame) -> DataFrame:
    """Latest pending event of each record, field and table; events delivered twice count once."""
    waiting = events.filter("approved_at is null and discarded_at is null")
    best = waiting.groupBy("resource_id", "field_key", "target_table").agg(F.max("id").alias("id"), F.max_by(F.struct("old_value", "new_value", "created_at"), F.struct("id", "created_at", "new_value")).alias("e"))
    return best.select("id", "resource_id", "field_key", "target_table", "e.old_value", "e.new_value")


def overlay(records: DataFrame, events: DataFrame, table: str = "utb_metadata_arr") -> DataFrame:
    """``resource_id, field_key, shown, is_pending``: each editable field as displayed, with pending changes on top."""
    fields = {"dc.title": "dc_title", "dc.contributor.author": "dc_contributor_author", "dc.publisher": "dc_publisher", "dc.relation.ispartof": "dc_relation_ispartof", "dc.identifier.issn": "dc_identifier_issn", "utb.faculty": "utb_faculty", "utb.ou": "utb_ou"}
    flat = records.select("resource_id", F.inline(F.array(*[F.struct(F.lit(k).alias("field_key"), X.to_display(F.col(c)).alias("value")) for k, c in fields.items()])))
    waiting = pending_changes(events.filter(F.col("target_table") == table)).select("resource_id", "field_key", F.col("new_value").alias("changed"), F.lit(True).alias("p"))
    out = flat.join(waiting, ["resource_id", "field_key"], "left")
    return out.select("resource_id", "field_key", F.coalesce(F.when(F.col("p"), F.col("changed")), F.col("value")).alias("shown"), F.coalesce("p", F.lit(False)).alias("is_pending"))


def save_field(events: DataFrame, change: DataFrame, baseline: DataFrame) -> DataFrame:
    """``events`` with the appended ``change``; pending events of a field set back to its ``baseline`` are discarded.

    ``baseline``: ``resource_id, field_key, value``.
    """
    back = change.join(baseline, ["resource_id", "field_key"]).filter(F.col("new_value").eqNullSafe(F.col("value"))).select("resource_id", "field_key", F.lit(True).alias("__back")).distinct()
    marked = events.join(back, ["resource_id", "field_key"], "left")
    pending = F.col("approved_at").isNull() & F.col("discarded_at").isNull()
    marked = marked.withColumn("discarded_at", F.when(F.col("__back") & pending, F.current_timestamp()).otherwise(F.col("discarded_at"))).select(*events.columns)
    return marked.unionByName(change.join(back.drop("__back"), ["resource_id", "field_key"], "left_anti"), allowMissingColumns=True)


def approve(records: DataFrame, events: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new records, events): pending changes of the records ``ids`` applied and stamped."""
    chosen = events.join(ids.select("resource_id").distinct(), "resource_id", "left_semi")
    waiting = pending_changes(chosen).withColumn("column", F.replace("field_key", F.lit("."), F.lit("_")))
    fields = sorted(c for c in records.columns if c.startswith(("dc_", "utb_")))
    by = waiting.groupBy("resource_id").pivot("column", fields).agg(F.first("new_value"))
    by = by.select("resource_id", *[F.col(f).alias(f"__{f}") for f in fields])
    types = dict(records.dtypes)
    typed = lambda f: X.split_display(F.col(f"__{f}")) if types[f].startswith("array") else F.col(f"__{f}")
    out = records.join(by, "resource_id", "left").withColumns({f: F.coalesce(F.when(F.col(f"__{f}").isNotNull(), typed(f)), F.col(f)) for f in fields}).select(*records.columns)
    mark = ids.select("resource_id").distinct().withColumn("__a", F.lit(True))
    stamped = events.join(mark, "resource_id", "left").withColumn("approved_at", F.when(F.col("__a") & F.col("approved_at").isNull() & F.col("discarded_at").isNull(), F.current_timestamp()).otherwise(F.col("approved_at"))).select(*events.columns)
    return out, stamped


def proposed_value(rows: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """``rows`` with ``proposed``: the first of the columns ``order`` that isn't null or blank, and ``proposed_by``."""
    full = lambda c: F.coalesce(X.utrim(F.col(c)) != "", F.lit(False))
    value, by = F.lit(None).cast("string"), F.lit(None).cast("string")
    for c in reversed(order):
        value, by = F.when(full(c), F.col(c)).otherwise(value), F.when(full(c), F.lit(c)).otherwise(by)
    return rows.withColumn("proposed", value).withColumn("proposed_by", by)


def field_list(fields: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """``fields`` (``resource_id, field_key, shown``) with ``row``: configured fields in their order, then those with a value, then the rest."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("field_key")) if order else F.lit(0)
    key = F.struct((place == 0).alias("other"), F.when(place > 0, place).otherwise(0).alias("place"), F.coalesce("shown", F.lit("")).eqNullSafe("").alias("blank"), F.col("field_key"))
    return fields.withColumn("row", F.row_number().over(Window.partitionBy("resource_id").orderBy(key)))


def duplicate_matches(flags: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``resource_id, other, match_type, score``: links written as JSON in several flag columns, each once; bad JSON gives none."""
    kind = "array<struct<other:bigint,match_type:string,score:double>>"
    lists = F.array_distinct(F.concat(*[F.coalesce(F.from_json(c, kind), F.array().cast(kind)) for c in columns]))
    return flags.select("resource_id", F.inline(lists)).filter("other is not null").distinct()


def merged_children(history: DataFrame) -> DataFrame:
    """``kept_id, resource_id, merged_at``: records merged into each survivor, newest first by ``n``, repeated rows once."""
    rows = history.filter("resource_id <> dedup_kept_resource_id").groupBy(F.col("dedup_kept_resource_id").cast("bigint").alias("kept_id"), "resource_id").agg(F.max("dedup_merged_at").alias("merged_at"))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("kept_id").orderBy(F.desc("merged_at"), "resource_id")))


def mark_checked(records: DataFrame, ids: DataFrame, column: str = "librarian_checked_at") -> DataFrame:
    """``records`` with the time appended to ``column`` of the records ``ids``."""
    have = F.col(column) if column in records.columns else F.lit(None).cast("array<timestamp>")
    mark = ids.select("resource_id").distinct().withColumn("__c", F.lit(True))
    out = records.join(mark, "resource_id", "left")
    now = F.array_append(F.coalesce(have, F.array().cast("array<timestamp>")), F.current_timestamp())
    return out.withColumn(column, F.when(F.col("__c"), now).otherwise(have)).drop("__c")


def author_summaries(registry: DataFrame) -> DataFrame:
    """``name, persons, places, faculties``: registry rows grouped by the normalised display name, distinct faculties in order."""
    rows = registry.select(X.normalise(F.col("display_name")).alias("name"), "author_id", F.nullif(F.trim("faculty"), F.lit("")).alias("faculty")).filter("name <> ''")
    return rows.groupBy("name").agg(F.countDistinct("author_id").alias("persons"), F.count("*").alias("places"), F.array_join(F.array_sort(F.collect_set("faculty")), "||").alias("faculties"))


def flag_rows(flags: DataFrame) -> DataFrame:
    """``resource_id, other, match_type, score, is_live`` of flags written as JSON."""
    kind = "array<struct<other:bigint,match_type:string,score:double,is_live:boolean>>"
    return flags.select("resource_id", F.inline(F.from_json("duplicates", kind)))


def top_candidates(scored: DataFrame, n: int = 80, least: int = 10) -> DataFrame:
    """``scored`` (``resource_id, name, score``) with ``rank``: the ``n`` best of each record with a score, padded to ``least`` by the rest."""
    by = Window.partitionBy("resource_id").orderBy(F.desc("score"), "name")
    ranked = scored.withColumn("rank", F.row_number().over(by))
    return ranked.filter(((F.col("score") > 0) & (F.col("rank") <= n)) | (F.col("rank") <= least))
