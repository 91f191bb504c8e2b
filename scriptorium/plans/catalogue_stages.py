"""Queries over the stages: authors in full, look-ups, statuses, review and bootstrapping."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from scriptorium import schema
from scriptorium.functions import text as X
from scriptorium.operators import affiliations, authors, completion, crossref, dedup, journals, review, validate
from scriptorium.plans.lineage import ensure_checkpoint_dir, reliable
from scriptorium.sources import snapshots
from scriptorium.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _records(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "utb_metadata_arr")


def _units(s: SparkSession, d: str) -> DataFrame:
    ref = table(s, d, "canonical_ref").filter("kind in ('faculty', 'ou')")
    return ref.select(F.col("ref_id").alias("id"), F.col("canonical_name").alias("name"), F.col("parent_ref_id").alias("parent_id"))


def _translations(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "canonical_ref").filter("kind = 'faculty' and alt_name is not null").select(F.col("alt_name").alias("czech"), F.col("canonical_name").alias("english"))


def _matches(s: SparkSession, d: str) -> DataFrame:
    return authors.match_names(_records(s, d).select(F.explode("dc_contributor_author").alias("name")), table(s, d, "utb_authors"))


def _preferred(s: SparkSession, d: str) -> DataFrame:
    people = authors.resolve_authors(_records(s, d), _matches(s, d))
    return people.select("resource_id", authors.identity(F.col("author_id"), F.col("name")).alias("identity"), "name", "pos")


def _ambiguous(s: SparkSession, d: str) -> DataFrame:
    found = authors.ambiguous_names(_records(s, d), _matches(s, d), table(s, d, "utb_authors"))
    return found.withColumn("candidates", F.array_join(F.transform("candidates", lambda x: x.cast("string")), "|"))


def _attributed(s: SparkSession, d: str, matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    from scriptorium.plans.pipeline import workplaces

    records, registry, units = _records(s, d), table(s, d, "utb_authors"), _units(s, d)
    people = reliable(authors.resolve_authors(records, matches))
    blocks = affiliations.affiliation_blocks(records).filter("is_home and author is not null")
    return people, authors.attribute(people, workplaces(blocks, people, units), authors.default_affiliations(registry, units))


def _author_records(s: SparkSession, d: str) -> DataFrame:
    records, matches = _records(s, d), reliable(_matches(s, d))
    people, attributed = _attributed(s, d, matches)
    rows = authors.author_records(records, people, reliable(attributed), authors.ambiguous_names(records, matches, table(s, d, "utb_authors")), affiliations.block_warnings(records))
    count = lambda key, kind: F.greatest(F.coalesce(F.size(F.from_json(F.get_json_object("flags", f"$.{key}"), f"array<{kind}>")), F.lit(0)), F.lit(0)).cast("bigint").alias(f"n_{key}")
    joined = lambda c: F.array_join(c, "||").alias(c)
    return rows.select("resource_id", joined("names"), joined("faculties"), joined("ous"), count("conflicts", "struct<author_id:bigint>"), count("unresolved", "bigint"), count("ambiguous", "string"), F.get_json_object("flags", "$.wos_ok").cast("boolean").alias("wos_ok"), F.get_json_object("flags", "$.duplicates").alias("duplicates"), "needs_llm")


def _english_units(s: SparkSession, d: str) -> DataFrame:
    units = table(s, d, "canonical_ref").filter("kind in ('faculty', 'ou')")
    written = F.when(F.col("ref_id") % 3 == 0, F.concat(F.lit("EN_"), "canonical_name")).otherwise(F.col("canonical_name"))
    return authors.english_names(units.select(F.col("ref_id").alias("id"), written.alias("name_en"), F.col("alt_name").alias("name_cs")), _translations(s, d))


def _history(s: SparkSession, d: str) -> DataFrame:
    records = _records(s, d)
    links = dedup.survivor(dedup.content_links(records), records)
    plan = dedup.plan_merges(links.select(F.struct("id_a", "id_b", "match_type").alias("seq"), "kept_id", "deleted_id"))
    past = snapshots.with_audit(dedup.merge_records(records, plan)[1])
    return past.groupBy("resource_id", "dedup_kept_resource_id", "dedup_other_resource_id").agg(F.count("*").alias("copies"))


def _unknown_authors(s: SparkSession, d: str) -> DataFrame:
    names = table(s, d, "utb_authors").select(F.explode(F.split("display_name", r"\|\|")).alias("name"))
    rows = validate.validation_issues(_records(s, d), names).select("resource_id", F.explode("issues").alias("rule", "fields"))
    return rows.filter("rule = 'authors_not_in_registry'").select("resource_id", F.array_join("fields", "||").alias("names"))


def _checked(s: SparkSession, d: str) -> DataFrame:
    return _records(s, d).select("resource_id", F.when(F.col("resource_id") % 3 == 0, "ok").otherwise("not_checked").alias("status"))


def _again(s: SparkSession, d: str) -> DataFrame:
    records = _records(s, d)
    return validate.after_fixes(validate.validation_issues(records), validate.suggested_fixes(records)).select("resource_id", "status")


def _answers(s: SparkSession, d: str) -> DataFrame:
    """Answers of offline providers, made from every third record: some with a publisher alone."""
    some = _records(s, d).filter("resource_id % 3 = 0")
    journal, publisher = F.try_element_at("dc_relation_ispartof", F.lit(1)), F.try_element_at("dc_publisher", F.lit(1))
    doi = some.select(F.lit("crossref").alias("provider"), F.lower(X.clean_doi(F.try_element_at("dc_identifier_doi", F.lit(1)))).alias("key"), publisher.alias("publisher"), F.when(F.col("resource_id") % 2 == 0, journal).alias("journal"))
    issn = some.select(F.lit("openalex").alias("provider"), F.explode(X.parse_issns(F.col("dc_identifier_issn"))).alias("key"), publisher.alias("publisher"), F.when(F.col("resource_id") % 2 == 0, journal).alias("journal"))
    return doi.unionByName(issn).filter("key <> ''").groupBy("provider", "key").agg(F.min("publisher").alias("publisher"), F.min("journal").alias("journal"))


def _confirmed(s: SparkSession, d: str) -> DataFrame:
    return journals.journal_groups(_records(s, d)).filter("group_id < '5'").select("group_id")


def _applied(s: SparkSession, d: str) -> DataFrame:
    records = _records(s, d)
    return journals.apply_proposals(records, journals.propose(records)).select("resource_id", X.to_display(F.col("dc_publisher")).alias("publisher"), X.to_display(F.col("dc_relation_ispartof")).alias("journal"))


def _listed(s: SparkSession, d: str) -> DataFrame:
    first = lambda c: F.try_element_at(c, F.lit(1))
    return _records(s, d).select("resource_id", first("dc_title").alias("title"), first("dc_date_issued").alias("issued"), X.to_display(F.col("dc_contributor_author")).alias("names"), first("dc_relation_ispartof").alias("journal"), F.lower(first("dc_identifier_doi")).alias("dup_key"))


def _scored(s: SparkSession, d: str) -> DataFrame:
    rows = _records(s, d).select("resource_id", F.explode("dc_contributor_author").alias("name")).distinct()
    return rows.withColumn("score", F.when(F.col("name").contains(","), F.length("name") % 7).otherwise(0))


def _saved(s: SparkSession, d: str) -> DataFrame:
    """Every third pending change made again, every second of these back to what was there before."""
    events = table(s, d, "utb_change_buffer")
    pending = reliable(review.pending_changes(events).filter("id % 3 = 0"))
    change = pending.select((F.col("id") + 100_000_000).alias("id"), "resource_id", "field_key", "target_table", F.when(F.col("id") % 2 == 0, F.col("old_value")).otherwise(F.concat("new_value", F.lit("!"))).alias("new_value"))
    saved = review.save_field(events.distinct(), change, pending.select("resource_id", "field_key", F.col("old_value").alias("value")).distinct())
    state = F.when(F.col("approved_at").isNotNull(), "approved").when(F.col("discarded_at").isNotNull(), "discarded").otherwise("pending")
    return saved.groupBy("resource_id", state.alias("state")).agg(F.count("*").alias("n"))


def _approved(s: SparkSession, d: str) -> DataFrame:
    records, events = _records(s, d), table(s, d, "utb_change_buffer")
    out, _ = review.approve(records, events.filter(F.col("target_table") == "utb_metadata_arr"), records.filter("resource_id % 2 = 0").select("resource_id"))
    return out.select("resource_id", X.to_display(F.col("dc_publisher")).alias("publisher"), X.to_display(F.col("dc_contributor_author")).alias("names"), X.to_display(F.col("utb_ou")).alias("ou"))


def _duplicate_matches(s: SparkSession, d: str) -> DataFrame:
    records = _records(s, d)
    flags = dedup.duplicate_flags(dedup.content_links(records), records.select("resource_id"))
    return review.duplicate_matches(flags.withColumn("again", F.col("duplicates")).withColumn("bad", F.lit("{no json")), ("duplicates", "again", "bad"))


def _two_answers(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "llm_author_entry").select("resource_id", "entry_pos", F.col("ou").alias("llm"), F.col("faculty").alias("heuristic"))


def _external_ids(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "utb_authors").select("author_id", "poradie", F.concat_ws(" ", "display_name", "orcid", F.concat(F.lit("id "), "scopusid"), "wos_id").alias("t")).distinct()
    return rows.select("author_id", "poradie", "t", *[X.external_id(F.col("t"), k).alias(k) for k in ("orcid", "scopus", "wos")])


def _copied(events: DataFrame) -> DataFrame:
    """Events as a bootstrap copies them: one row for each id."""
    folder = f"{ensure_checkpoint_dir(events.sparkSession)}/bootstrap-{uuid4().hex}"
    return snapshots.bootstrap(events, folder, key="id").groupBy("field_key").agg(F.count("*").alias("n"))


# Relational types of the change buffer.
_BUFFER_TYPES = [("id", "bigint", False), ("resource_id", "int8", True), ("field_key", "character varying(120)", True), ("target_table", "text", True), ("old_value", "text", True), ("new_value", "text", True), ("created_at", "timestamp with time zone", True), ("approved_at", "timestamptz", True), ("discarded_at", "timestamptz", True), ("tags", "_varchar", True), ("sizes", "integer[]", True)]


def _typed(s: SparkSession, d: str) -> DataFrame:
    """Types that the relational schema of the change buffer is read as."""
    made = schema.build_schema(_BUFFER_TYPES)
    return s.createDataFrame([(f.name, f.dataType.simpleString(), f.nullable) for f in made.fields], "name string, spark_type string, nullable boolean")


def _answer(entry: str) -> str:
    """A completer that answers a prompt, a JSON object, by putting it between fences."""
    return f"Here it is:\n```json\n{entry}\n```"


def _salvaged(s: SparkSession, d: str) -> DataFrame:
    @F.pandas_udf("string")
    def read(texts: pd.Series) -> pd.Series:
        def one(text: str) -> str | None:
            try:
                return completion.salvage_json(text).get("by")
            except ValueError:
                return None

        return texts.map(one)

    rows = table(s, d, "dedup_histoire").select("dedup_match_details").distinct()
    return rows.select("dedup_match_details", read(F.concat(F.lit("```json "), F.coalesce("dedup_match_details", F.lit("none")), F.lit(" ``` end"))).alias("basis"))


def _completed_authors(s: SparkSession, d: str) -> DataFrame:
    """Entries given as an answer: checked, names outside the candidates dropped, workplaces made those of the list."""
    entries = table(s, d, "llm_author_entry").filter("name is not null")
    units = [r["canonical_name"] for r in table(s, d, "canonical_ref").filter("kind = 'ou'").orderBy("ref_id").select("canonical_name").collect()]  # the list is fixed
    faculties = {r["canonical_name"]: r["canonical_name"] for r in table(s, d, "canonical_ref").filter("kind = 'faculty'").select("canonical_name").collect()}
    told = F.array_sort(F.collect_list(F.struct("entry_pos", "name", F.coalesce("faculty", F.lit("")).alias("faculty"), F.coalesce("ou", F.lit("")).alias("ou"))))
    asked = entries.groupBy("resource_id").agg(F.transform(told, lambda x: F.struct(x["name"].alias("name"), x["faculty"].alias("faculty"), x["ou"].alias("ou"))).alias("authors"), F.array_sort(F.collect_set(F.when(F.col("entry_pos") % 2 == 1, F.col("name")))).alias("candidates"))
    done = completion.complete_authors(asked.withColumn("prompt", F.to_json(F.struct("authors"))), _answer, faculties, units)
    return done.select("resource_id", "status", *[F.array_join(c, "||").alias(c) for c in ("names", "faculties", "ous")])


def _completed_dates(s: SparkSession, d: str) -> DataFrame:
    """Dates given as an answer: what is no day from 1990 to 2035 is emptied, and laid over the heuristic's."""
    records = _records(s, d)
    raw = F.array_join("utb_fulltext_dates", " ")
    prompt = F.to_json(F.struct(F.try_element_at("dc_date_issued", F.lit(1)).alias("published"), F.substring(F.try_element_at("dc_date_accessioned", F.lit(1)), 1, 10).alias("accepted")))
    asked = records.select("resource_id", raw.alias("raw"), F.when(F.col("resource_id") % 10 == 0, "nothing").when(F.col("resource_id") % 10 == 1, '{"other": 1}').otherwise(prompt).alias("prompt"))
    return completion.complete_dates(asked, _answer).select("resource_id", "status", "accepted", "published")


def _crossref_details(s: SparkSession, d: str) -> DataFrame:
    first = lambda c: F.try_element_at(c, F.lit(1))
    year, day = F.col("resource_id") % 30 + 1990, F.col("resource_id") % 28 + 1
    date = lambda *parts: F.struct(F.array(F.array(*[p.cast("int") for p in parts])).alias("date-parts"))
    message = F.to_json(F.struct(
        F.when(F.col("resource_id") % 2 == 0, date(year, day % 12 + 1, day)).alias("published-print"), F.when(F.col("resource_id") % 3 == 0, date(year, day % 12 + 1)).alias("published-online"), date(year).alias("issued"),
        F.array(F.struct(first("dc_publisher").alias("name"), F.coalesce("dc_type", F.array().cast("array<string>")).alias("award"))).alias("funder"), F.array(F.struct(first("dc_identifier_doi").alias("URL"))).alias("license"),
        F.array(F.struct(first("dc_identifier_issn").alias("value"), F.lit("print").alias("type"))).alias("issn-type"), first("dc_identifier_doi").alias("URL"), F.concat_ws("-", first("dc_citation_spage"), first("dc_citation_epage")).alias("page"),
    ))
    return crossref.work_fields(_records(s, d).select("resource_id", message.alias("message"))).select("resource_id", "dc_date_issued", "dc_date_available", "funders", "dc_rights_uri", "issn_types", "dc_identifier_uri", "dc_citation_epage")


def queries() -> dict[str, Query]:
    """Query name to a function of session and folder."""
    return {
        "validation_registry": _unknown_authors,
        "url_fixes": lambda s, d: validate.suggested_fixes(_records(s, d).withColumn("dc_identifier_uri", F.col("dc_identifier_doi"))).filter("fix_type = 'url_query'").select("resource_id", F.array_join("suggested", "||").alias("suggested")),
        "validation_due": lambda s, d: snapshots.due(_records(s, d), _checked(s, d), "status", ["not_checked"]).select("resource_id"),
        "validation_again": _again,
        "records_fetched": lambda s, d: snapshots.fetch(_records(s, d), table(s, d, "llm_author_entry")).select("resource_id", F.size("dc_title").alias("n_titles")),
        "records_first_page": lambda s, d: snapshots.page(_records(s, d), 9999).select("resource_id"),
        "records_smallest_page": lambda s, d: snapshots.page(_records(s, d), 0).select("resource_id"),
        "units_valid": lambda s, d: snapshots.valid_units(_units(s, d).withColumn("valid_to", F.when(F.col("id") % 4 == 0, F.date_add(F.lit("2024-01-01").cast("date"), F.col("id") - 110)).cast("date")), "2024-01-01").select("id", "name"),
        "journal_lookup_keys": lambda s, d: journals.lookup_keys(_records(s, d)).select("id_kind", "group_id", "key_kind", "provider", "key", "step", "rank"),
        "journal_lookups": lambda s, d: journals.looked_up(journals.lookup_keys(_records(s, d)), _answers(s, d)),
        "journal_proposals_looked_up": lambda s, d: journals.propose(_records(s, d), _answers(s, d)),
        "journal_applied": lambda s, d: validate.status_counts(journals.mark_applied(journals.propose(_records(s, d)), groups=_confirmed(s, d))),
        "journal_statuses_set": lambda s, d: validate.status_counts(journals.set_status(journals.propose(_records(s, d)), "error", _records(s, d).filter("resource_id % 5 = 0"))),
        "journal_records_applied": _applied,
        "journal_limited": lambda s, d: journals.limit_groups(journals.propose(_records(s, d)), 20).groupBy("group_id").agg(F.count("*").alias("n")),
        "record_page": lambda s, d: review.ordered(_listed(s, d), "issued_desc").limit(200).select("resource_id", "issued"),
        "record_page_grouped": lambda s, d: review.ordered(_listed(s, d), "title", "dup_key").limit(200).select("resource_id", "title"),
        "record_relevance": lambda s, d: review.relevance(_listed(s, d), "polymer", "title", ("names", "journal")).select("resource_id", "score"),
        "author_candidates": lambda s, d: review.top_candidates(_scored(s, d), 3, 2).select("resource_id", "name", "score", "rank"),
        "field_rows": lambda s, d: review.field_list(review.overlay(_records(s, d), table(s, d, "utb_change_buffer")).filter("resource_id % 4 = 0"), ("dc.title", "utb.ou", "dc.publisher")).select("resource_id", "field_key", "row"),
        "changes_saved": _saved,
        "changes_approved": _approved,
        "records_checked": lambda s, d: review.mark_checked(_records(s, d), table(s, d, "dedup_histoire")).groupBy((F.coalesce(F.size("librarian_checked_at"), F.lit(0)) > 0).alias("is_checked")).agg(F.count("*").alias("n")),
        "duplicate_matches": _duplicate_matches,
        "values_proposed": lambda s, d: review.proposed_value(_two_answers(s, d), ("llm", "heuristic")).select("resource_id", "entry_pos", "proposed", "proposed_by"),
        "display_values": lambda s, d: _records(s, d).select("resource_id", X.to_display(F.col("dc_contributor_author")).alias("shown")).select("resource_id", "shown", F.size(X.split_display(F.col("shown"))).alias("n")).filter("shown is not null"),
        "jats_stripped": lambda s, d: _records(s, d).select("resource_id", X.strip_jats(F.concat(F.lit("<jats:p>"), F.try_element_at("dc_description_abstract", F.lit(1)), F.lit(" </jats:p>"))).alias("text")).filter("text is not null"),
        "external_ids": _external_ids,
        "json_migrated": lambda s, d: snapshots.migrate_json(table(s, d, "dedup_histoire").select("resource_id", "dedup_other_resource_id", F.when(F.col("resource_id") % 3 == 0, F.concat_ws(" ", "dedup_match_type")).when(F.col("resource_id") % 3 == 1, F.col("dedup_match_details")).alias("details")), "details").distinct(),
        "legacy_columns": lambda s, d: snapshots.rename_legacy(_records(s, d).select("resource_id", F.col("author_flags").alias("flags"), F.size("utb_faculty").alias("utb_faculty"))),
        "increments": lambda s, d: snapshots.increments_view(s, _records(s, d).select("resource_id", "utb_relation_volume"), table(s, d, "dedup_histoire").select("resource_id", "utb_relation_volume"), "with_increments").groupBy("resource_id").agg(F.count("*").alias("n")),
        "columns_synced": lambda s, d: snapshots.with_columns(_records(s, d).select("resource_id", "utb_relation_volume"), table(s, d, "dedup_histoire").select("resource_id", "dedup_match_type")).groupBy("dedup_match_type", F.col("utb_relation_volume").isNull().alias("no_volume")).agg(F.count("*").alias("n")),
        "bootstrap_rows": lambda s, d: _copied(table(s, d, "utb_change_buffer")),
        "typed_columns": _typed,
        "salvaged_answers": _salvaged,
        "authors_completed": _completed_authors,
        "dates_completed": _completed_dates,
        "prompts": lambda s, d: completion.author_prompt(_records(s, d).select("resource_id", F.coalesce("dc_contributor_author", F.array().cast("array<string>")).alias("names"), F.coalesce("utb_wos_affiliation", F.array().cast("array<string>")).alias("affiliations"), F.coalesce("utb_contributor_internalauthor", F.array().cast("array<string>")).alias("candidates"))).select("resource_id", "prompt"),
        "crossref_details": _crossref_details,
        "scopus_parts": lambda s, d: affiliations.affiliation_blocks(_records(s, d)).filter("source = 'scopus'").select("affiliation").distinct().select("affiliation", affiliations.scopus_parts(F.col("affiliation")).alias("p")).select("affiliation", "p.department", "p.faculty", "p.institution"),
        "dedup_history": _history,
        "preferred_names": _preferred,
        "ambiguous_authors": _ambiguous,
        "author_records": _author_records,
        "registry_surnames": lambda s, d: authors.with_surnames(table(s, d, "utb_authors")).select("author_id", "poradie", "surname", "given_name").distinct(),
        "english_units": _english_units,
        "person_data": lambda s, d: authors.person_data(table(s, d, "utb_authors"), _units(s, d), _translations(s, d)).withColumn("faculties", F.array_join("faculties", "||")),
    }
