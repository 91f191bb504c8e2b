"""Queries over the core operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from scriptorium.functions import text as X
from scriptorium.functions.similarity import jaro_winkler_udf
from scriptorium.operators import affiliations, authors, crossref, dates, dedup, journals, packed, review, timestamps, tree, validate
from scriptorium.plans import catalogue_stages, oracles, oracles_stages
from scriptorium.sources import snapshots
from scriptorium.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _records(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "utb_metadata_arr")


def _units(s: SparkSession, d: str) -> DataFrame:
    ref = table(s, d, "canonical_ref").filter("kind in ('faculty', 'ou')")
    return ref.select(F.col("ref_id").alias("id"), F.col("canonical_name").alias("name"), F.col("parent_ref_id").alias("parent_id"))


def _elements(df: DataFrame, column: str) -> DataFrame:
    return df.select("resource_id", F.posexplode(column).alias("p", "x")).select("resource_id", (F.col("p") + 1).cast("int").alias("pos"), "x").filter("x is not null")


def _text_fix(s: SparkSession, d: str) -> DataFrame:
    fixed, kinds = X.text_fixes(F.col("x"))
    rows = _elements(_records(s, d), "dc_title").select("resource_id", "pos", fixed.alias("fixed"), *[k.alias(n) for n, k in kinds], F.col("x"))
    return rows.filter("fixed <> x").drop("x")


def _doi_clean(s: SparkSession, d: str) -> DataFrame:
    x = F.col("x")
    return _elements(_records(s, d), "dc_identifier_doi").select("resource_id", "pos", X.is_doi(x).alias("valid"), X.clean_doi(x).alias("cleaned"), X.clean_doi(x).rlike(X.DOI_FORM).alias("valid_after"))


def _validation_rows(s: SparkSession, d: str) -> DataFrame:
    return validate.validation_issues(_records(s, d)).select("resource_id", F.explode("issues").alias("rule", "fields")).select("resource_id", "rule")


def _content(s: SparkSession, d: str) -> DataFrame:
    return dedup.content_links(_records(s, d))


def _match_exact(s: SparkSession, d: str) -> DataFrame:
    forms = authors.registry_forms(table(s, d, "utb_authors")).select("author_id", "norm").distinct()
    names = _records(s, d).select(F.explode("dc_contributor_author").alias("name")).filter(F.trim("name") != "").distinct().withColumn("norm", X.match_form(F.col("name")))
    return names.filter("norm <> ''").join(forms, "norm").groupBy("name").agg(F.min("author_id").alias("author_id"), F.countDistinct("author_id").alias("n"))


def _author_matches(s: SparkSession, d: str) -> DataFrame:
    return authors.match_names(_records(s, d).select(F.explode("dc_contributor_author").alias("name")), table(s, d, "utb_authors"))


def _attribution(s: SparkSession, d: str) -> DataFrame:
    from scriptorium.plans.pipeline import workplaces

    records, registry, units = _records(s, d), table(s, d, "utb_authors"), _units(s, d)
    people = authors.resolve_authors(records, _author_matches(s, d))
    blocks = affiliations.affiliation_blocks(records).filter("is_home and author is not null")
    return authors.attribute(people, workplaces(blocks, people, units), authors.default_affiliations(registry, units))


def _similarity(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "utb_authors").select("author_id", "poradie", "display_name", F.concat_ws(", ", "surname", "given_name").alias("full")).filter("full <> '' and display_name is not null").distinct()
    plain = a.select("author_id", "poradie", "display_name", "full", X.normalise(F.col("display_name")).alias("x"), X.normalise(F.col("full")).alias("y"))
    return plain.select("author_id", "poradie", "display_name", "full", F.round(jaro_winkler_udf("x", "y"), 4).alias("score")).distinct()


def _works(s: SparkSession, d: str) -> DataFrame:
    r = _records(s, d).select("resource_id", F.to_json(F.struct(
        F.col("dc_title").alias("title"), F.try_element_at("dc_publisher", F.lit(1)).alias("publisher"), F.col("utb_relation_volume").alias("volume"),
        F.concat_ws("-", F.try_element_at("dc_citation_spage", F.lit(1)), F.try_element_at("dc_citation_epage", F.lit(1))).alias("page"),
        F.col("dc_identifier_issn").alias("ISSN"), F.transform(F.coalesce("dc_contributor_author", F.array().cast("array<string>")), lambda x: F.struct(x.alias("name"))).alias("author"),
    )).alias("message"))
    return crossref.work_fields(r).select("resource_id", "dc_title", "dc_publisher", "utb_relation_volume", "dc_identifier_issn", "dc_contributor_author", "dc_citation_spage")


def _merge_variants(s: SparkSession, d: str) -> DataFrame:
    names = _records(s, d).select("resource_id", F.posexplode("dc_contributor_author").alias("pos", "name"))
    return authors.merge_names(names).select("resource_id", F.array_join("names", "||").alias("names"))


def _merge_plan(s: SparkSession, d: str) -> DataFrame:
    r = _records(s, d)
    links = dedup.survivor(dedup.content_links(r), r)
    return dedup.plan_merges(links.select(F.struct("id_a", "id_b", "match_type").alias("seq"), "kept_id", "deleted_id"))


def _find_units(s: SparkSession, d: str) -> DataFrame:
    texts = table(s, d, "llm_author_entry").select(F.col("ou").alias("text")).filter(F.trim("text") != "")
    return tree.find_nodes(texts, _units(s, d).filter("parent_id is not null").select("id", "name"))


def queries() -> dict[str, Query]:
    """Query name to a function of session and folder."""
    return {
        "p3_found": lambda s, d: packed.p3_found(_records(s, d), table(s, d, "utb_change_buffer")),
        "p6_found": lambda s, d: timestamps.p6_found(_records(s, d)),
        "dedup_exact_groups": lambda s, d: dedup.exact_groups(_records(s, d), "dc_identifier_doi"),
        "dedup_exact_members": lambda s, d: dedup.exact_members(_records(s, d), "dc_identifier_doi"),
        "dedup_pair_count": lambda s, d: dedup.pair_count(dedup.exact_groups(_records(s, d), "utb_identifier_wok")),
        "dedup_content_links": _content,
        "dedup_fuzzy_links": lambda s, d: dedup.fuzzy_links(_records(s, d)),
        "dedup_link_counts": lambda s, d: dedup.link_counts(_content(s, d)),
        "dedup_survivors": lambda s, d: dedup.survivor(_content(s, d), _records(s, d)),
        "dedup_flags": lambda s, d: review.flag_rows(dedup.duplicate_flags(_content(s, d), _records(s, d).select("resource_id"))),
        "dedup_flag_counts": lambda s, d: review.flag_rows(dedup.duplicate_flags(_content(s, d), _records(s, d).select("resource_id"))).groupBy("match_type").agg(F.count("*").alias("n")),
        "pending_records": lambda s, d: review.pending_changes(table(s, d, "utb_change_buffer")).groupBy("resource_id").agg(F.count("*").alias("n_changes")),
        "author_status": lambda s, d: validate.status_counts(_records(s, d).select(F.when(F.col("utb_contributor_internalauthor").isNull(), "not_processed").otherwise("processed").alias("status"))),
        "name_prefixes": lambda s, d: table(s, d, "utb_authors").filter("display_name is not null and surname is not null").select("author_id", "poradie", "display_name", "surname", F.round(X.common_prefix_ratio(F.col("display_name"), F.col("surname")), 6).alias("ratio")).distinct(),
        "dedup_merge_plan": _merge_plan,
        "dedup_merged_records": lambda s, d: dedup.merge_records(_records(s, d), _merge_plan(s, d))[0].select("resource_id", F.array_join("dc_contributor_author", "||").alias("names"), F.array_join("utb_source", "||").alias("sources")),
        "dedup_history_status": lambda s, d: table(s, d, "dedup_histoire").groupBy("dedup_match_type").agg(F.count("*").alias("n"), F.countDistinct("dedup_kept_resource_id").alias("kept")),
        "dedup_history_details": lambda s, d: table(s, d, "dedup_histoire").groupBy(F.get_json_object("dedup_match_details", "$.by").alias("basis")).agg(F.count("*").alias("n")),
        "merged_children": lambda s, d: review.merged_children(table(s, d, "dedup_histoire")).select("kept_id", "resource_id", "n"),
        "text_fix": _text_fix,
        "doi_clean": _doi_clean,
        "issn_parse": lambda s, d: _records(s, d).select("resource_id", F.array_join(X.parse_issns(F.col("dc_identifier_issn")), "|").alias("issns")).filter("issns <> ''"),
        "isbn_parse": lambda s, d: _records(s, d).select("resource_id", F.array_join(X.parse_isbns(F.col("dc_identifier_isbn")), "|").alias("isbns")).filter("isbns <> ''"),
        "year_histogram": lambda s, d: _records(s, d).groupBy(X.year_of(F.try_element_at("dc_date_issued", F.lit(1))).alias("year")).agg(F.count("*").alias("n")),
        "title_keys": lambda s, d: _records(s, d).select("resource_id", F.explode(X.title_keys(X.title_form(F.try_element_at("dc_title", F.lit(1))))).alias("block_key")).groupBy("block_key").agg(F.count("*").alias("n")).filter("n > 1"),
        "validation_rules": _validation_rows,
        "validation_status": lambda s, d: validate.status_counts(validate.validation_issues(_records(s, d))),
        "validation_issue_counts": lambda s, d: validate.issue_counts(validate.validation_issues(_records(s, d))),
        "validation_fixes": lambda s, d: validate.suggested_fixes(_records(s, d)).select("resource_id", "field_name", F.array_join("suggested", "||").alias("suggested"), "fix_type"),
        "obd_missing": lambda s, d: validate.missing_ids(_records(s, d), table(s, d, "documents").filter("resource_id is not null").select((F.col("resource_id") + 43000000).alias("id"))).select("resource_id", F.array_join("missing", "|").alias("missing")),
        "date_extraction": lambda s, d: dates.extract_dates(_records(s, d)).withColumn("flag_keys", F.array_join("flag_keys", "|")),
        "date_status": lambda s, d: dates.date_status(dates.extract_dates(_records(s, d))),
        "wos_blocks": lambda s, d: affiliations.affiliation_blocks(_records(s, d)).filter("source = 'wos'").select("resource_id", "author", "affiliation", "is_home"),
        "scopus_blocks": lambda s, d: affiliations.affiliation_blocks(_records(s, d)).filter("source = 'scopus'").select("resource_id", "author", "affiliation", "is_home"),
        "match_exact": _match_exact,
        "author_matches": _author_matches,
        "author_match_status": lambda s, d: _author_matches(s, d).groupBy("match_type").agg(F.count("*").alias("n")),
        "attribution": _attribution,
        "merge_variants": _merge_variants,
        "author_inputs": lambda s, d: authors.author_inputs(_records(s, d), affiliations.affiliation_blocks(_records(s, d)), table(s, d, "dedup_histoire")).select("resource_id", F.array_join("names", "||").alias("names")),
        "source_lists": lambda s, d: authors.source_lists(_records(s, d), table(s, d, "dedup_histoire")).groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("resource_id").alias("records")),
        "aligned_affiliations": lambda s, d: authors.align_blocks(_records(s, d), affiliations.affiliation_blocks(_records(s, d))),
        "wos_block_warnings": lambda s, d: affiliations.block_warnings(_records(s, d)),
        "list_group_counts": lambda s, d: review.list_groups(_records(s, d)).groupBy("list_group").agg(F.count("*").alias("n")),
        "default_affiliations": lambda s, d: authors.default_affiliations(table(s, d, "utb_authors"), _units(s, d)),
        "compare_curated": lambda s, d: authors.compare_sets(_records(s, d), "dc_contributor_author", "utb_contributor_internalauthor"),
        "name_similarity": _similarity,
        "tree_closure": lambda s, d: tree.closure(_units(s, d)),
        "walk_to_faculty": lambda s, d: tree.first_ancestor(tree.closure(_units(s, d)), _units(s, d).filter("parent_id is null")),
        "find_units": _find_units,
        "journal_canonical": lambda s, d: journals.canonical_values(journals.journal_groups(_records(s, d)), "journal"),
        "journal_proposals": lambda s, d: journals.propose(_records(s, d)),
        "journal_status": lambda s, d: validate.status_counts(journals.propose(_records(s, d))),
        "journal_top_groups": lambda s, d: journals.top_proposals(journals.propose(_records(s, d))),
        "journal_group_report": lambda s, d: journals.group_report(_records(s, d)),
        "source_flags": lambda s, d: review.source_flags(_records(s, d)),
        "list_groups": lambda s, d: review.list_groups(_records(s, d)),
        "search_records": lambda s, d: review.search(_records(s, d), "polymer"),
        "search_authors": lambda s, d: review.search_authors(table(s, d, "utb_authors"), "olga"),
        "author_summaries": lambda s, d: review.author_summaries(table(s, d, "utb_authors")),
        "pending_changes": lambda s, d: review.pending_changes(table(s, d, "utb_change_buffer")).select("id", "resource_id", "field_key", "target_table", "new_value"),
        "pending_overlay": lambda s, d: review.overlay(_records(s, d), table(s, d, "utb_change_buffer")),
        "crossref_fields": _works,
        "queue_missing": lambda s, d: snapshots.missing_rows(_records(s, d), table(s, d, "documents").filter("resource_id is not null"), {"validation_status": "not_checked"}),
        "json_props": lambda s, d: table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("total")),
    } | catalogue_stages.queries()


def oracle_sql() -> dict[str, str]:
    """Query name to DuckDB SQL."""
    return oracles.sql() | oracles_stages.sql()
