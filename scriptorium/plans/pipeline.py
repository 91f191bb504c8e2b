"""Stages over a workspace of Parquet snapshots, as functions and as commands.

A workspace holds ``records`` (input and each new version) and one folder for each stage's output, on any file system that
Spark can reach. Nothing is updated in place: each write is a new version folder, and the last one that was finished counts.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable
from dataclasses import dataclass
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession, functions as F

from scriptorium.operators import affiliations, authors, completion, dates, dedup, journals, tree, validate
from scriptorium.plans.lineage import reliable
from scriptorium.settings import Settings
from scriptorium.sources import snapshots
from scriptorium.sources.providers import Completer, Lookup, ask_lookup


@dataclass
class Workspace:
    """Folder of snapshots and the session that reads them."""

    spark: SparkSession
    root: str
    settings: Settings = Settings()

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _files(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self, name: str) -> list[int]:
        """Finished versions of a snapshot, oldest first; a write that was cut off left none."""
        path, fs = self._files(name)
        if not fs.exists(path):
            return []
        found = [f.getPath() for f in fs.listStatus(path) if f.getPath().getName().startswith("v")]
        return sorted(int(p.getName()[1:]) for p in found if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def has(self, name: str) -> bool:
        return bool(self.versions(name))

    def read(self, name: str) -> DataFrame:
        """Last finished version of a snapshot."""
        if not (have := self.versions(name)):
            raise FileNotFoundError(f"{self.path(name)} has no finished version")
        return self.spark.read.parquet(f"{self.path(name)}/v{have[-1]}")

    def write(self, df: DataFrame, name: str, keep: int = 2) -> DataFrame:
        """A new version, read back; versions before the last ``keep`` are removed, so a running reader keeps its own."""
        have = self.versions(name)
        df.write.mode("overwrite").parquet(f"{self.path(name)}/v{have[-1] + 1 if have else 1}")
        path, fs = self._files(name)
        for old in self.versions(name)[:-keep]:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path, f"v{old}"), True)
        return self.read(name)


def bootstrap(w: Workspace, source: str, drop: bool = False, limit: int | None = None) -> DataFrame:
    """Copy of the source records; kept if there is one already, unless ``drop``."""
    if w.has("records") and not drop:
        return w.read("records")
    return w.write(snapshots_input(w, source, limit), "records")


def snapshots_input(w: Workspace, source: str, limit: int | None) -> DataFrame:
    rows = w.spark.read.parquet(source).dropDuplicates(["resource_id"])
    return rows.orderBy("resource_id").limit(limit) if limit else rows


def init_stage_outputs(w: Workspace) -> DataFrame:
    """Queue with a row for every record, new ones with default states."""
    defaults = {"validation_status": "not_checked", "author_status": "not_processed", "date_status": "not_processed", "journal_status": "not_processed"}
    records = w.read("records")
    if not w.has("queue"):
        return w.write(records.select("resource_id").distinct().withColumns({k: F.lit(v) for k, v in defaults.items()}), "queue")
    queue = w.read("queue")
    return w.write(queue.unionByName(snapshots.missing_rows(records, queue, defaults)), "queue")


def run_validation(w: Workspace, statuses: list[str] | None = None, limit: int | None = None, revalidate: bool = False) -> DataFrame:
    """Issues and status of the records that are due (not yet checked, or of the given statuses), the others as they were."""
    names = authors.registry_forms(w.read("registry")).select("name") if w.has("registry") else None
    records = w.read("records")
    if not w.has("validation"):
        rows = records.orderBy("resource_id").limit(limit) if limit else records
        return w.write(validate.validation_issues(rows, names), "validation")
    past = w.read("validation")
    fresh = snapshots.missing_rows(records, past, {"status": "not_checked"})
    rows = snapshots.due(records, past.select("resource_id", "status").unionByName(fresh), "status", statuses or ["not_checked"], limit=limit, again=revalidate)
    done = validate.validation_issues(rows, names)
    return w.write(past.join(rows.select("resource_id"), "resource_id", "left_anti").unionByName(done), "validation")


def run_fixes(w: Workspace, preview: bool = False) -> DataFrame:
    """Suggested fixes; unless ``preview`` they are applied as a new version of the records, cleared, and the records are due again."""
    fixes = w.write(validate.suggested_fixes(w.read("records")), "fixes")
    if not preview:
        w.write(validate.apply_fixes(w.read("records"), fixes), "records")
        if w.has("validation"):
            w.write(validate.after_fixes(w.read("validation"), fixes), "validation")
        w.write(fixes.limit(0), "fixes")
    return fixes


def run_authors(w: Workspace) -> DataFrame:
    """Authors matched against the registry and attributed, with flags and whether a completer is needed."""
    records, registry, units = w.read("records"), w.read("registry"), w.read("units")
    names = records.select(F.explode("dc_contributor_author").alias("name"))
    matches = reliable(authors.match_names(names, authors.with_surnames(registry), w.settings))
    people = authors.resolve_authors(records, matches)
    blocks = affiliations.affiliation_blocks(records, w.settings).filter("is_home and author is not null")
    placed = workplaces(blocks, people, units, w.settings)
    attributed = authors.attribute(people, placed, authors.default_affiliations(registry, units), w.settings)
    found = authors.author_records(records, people, attributed, authors.ambiguous_names(records, matches, registry), affiliations.block_warnings(records, w.settings))
    return w.write(found, "authors")


def run_authors_completion(w: Workspace, completer: Completer) -> DataFrame:
    """Authors of the records that need it through a completer, laid over the heuristic's."""
    records, found, units = w.read("records"), w.read("authors"), w.read("units")
    blocks = affiliations.affiliation_blocks(records, w.settings).filter("is_home")
    asked = found.filter("needs_llm or names is null").select("resource_id").join(blocks, "resource_id").groupBy("resource_id").agg(F.array_sort(F.collect_set("affiliation")).alias("affiliations"), F.array_sort(F.collect_set("author")).alias("candidates"))
    todo = completion.author_prompt(records.select("resource_id", F.col("dc_contributor_author").alias("names")).join(asked, "resource_id"))
    names = [r["name"] for r in units.select("name").limit(tree.MAX_NODES + 1).collect()]
    if len(names) > tree.MAX_NODES:
        raise ValueError(f"more than {tree.MAX_NODES} units")
    done = completion.complete_authors(todo, completer, {n: n for n in names}, names).select("resource_id", *[F.col(c).alias(f"__{c}") for c in ("names", "faculties", "ous")])
    out = found.join(done, "resource_id", "left").withColumns({c: F.coalesce(F.when(F.size(f"__{c}") > 0, F.col(f"__{c}")), F.col(c)) for c in ("names", "faculties", "ous")})
    return w.write(out.select(*found.columns), "authors_merged")


def workplaces(blocks: DataFrame, people: DataFrame, units: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``resource_id, author_id, source, faculty, ou``: the unit found in the home affiliations of each person, by name key.

    Whole affiliations and their parts between commas and semicolons are looked up; one node is taken for each person and
    source, by score, then level, then length of its name, then the smaller id. Its faculty is the highest node above it.
    """
    keyed = blocks.withColumn("key", authors.name_key(F.col("author")))
    mine = people.select("resource_id", "author_id", authors.name_key(F.col("name")).alias("key"))
    texts = F.array_distinct(F.concat(F.array("affiliation"), F.split("affiliation", r"\s*[,;]\s*")))
    parts = reliable(keyed.join(mine, ["resource_id", "key"]).select("resource_id", "author_id", "source", F.explode(texts).alias("text")))
    found = tree.find_nodes(parts.select("text"), units.select("id", "name"), settings.workplace_threshold)
    paths = tree.closure(units)
    level = paths.groupBy(F.col("node").alias("id")).agg(F.max("depth").alias("level"))
    tops = tree.first_ancestor(paths, level.filter("level = 0")).select(F.col("node").alias("id"), F.col("ancestor").alias("top"))
    named = units.select("id", F.col("name").alias("unit")).join(level, "id").join(tops, "id").join(units.select(F.col("id").alias("top"), F.col("name").alias("faculty")), "top")
    best = F.max_by(F.struct("faculty", F.when(F.col("level") > 0, F.col("unit")).alias("ou")), F.struct("score", "level", F.length("unit"), -F.col("id")))
    return parts.join(found, "text").join(named, "id").groupBy("resource_id", "author_id", "source").agg(best.alias("w")).select("resource_id", "author_id", "source", "w.faculty", "w.ou")


def run_dates(w: Workspace) -> DataFrame:
    """Milestone dates of every record."""
    return w.write(dates.extract_dates(w.read("records"), backward_error=w.settings.backward_days_error), "dates")


def run_dates_completion(w: Workspace, completer: Completer) -> DataFrame:
    """Dates of the records that need it through a completer, laid over the heuristic's."""
    found = w.read("dates")
    todo = w.read("records").select("resource_id", F.array_join("utb_fulltext_dates", " ").alias("raw")).join(found.filter("needs_llm").select("resource_id"), "resource_id", "left_semi")
    done = w.write(completion.complete_dates(completion.date_prompt(todo), completer), "dates_completed")
    return w.write(completion.lay_over(found, done), "dates_merged")


def run_journals(w: Workspace, lookups: dict[str, Lookup] | None = None) -> DataFrame:
    """Proposed publishers and journals: those of the providers, in the order of the cascade, else those of the records."""
    records = w.read("records")
    answers = None
    if lookups:
        keys = journals.lookup_keys(records)
        for provider, lookup in sorted(lookups.items()):
            told = ask_lookup(keys, lookup, provider)
            answers = told if answers is None else answers.unionByName(told)
        answers = w.write(answers, "journal_answers")
    return w.write(journals.propose(records, answers), "journals")


def run_journal_apply(w: Workspace, issn: str | None = None, confirm: Callable[[str], bool] | None = None, preview: bool = False) -> DataFrame:
    """New version of the records with the proposals, which become ``applied``; ``confirm`` is asked for each group if it is given."""
    proposals = w.read("journals")
    if preview:
        return proposals.filter("status = 'has_proposal'")
    groups = None
    if confirm is not None:
        asked = proposals.filter("status = 'has_proposal' and group_id is not null").select("group_id").distinct().orderBy("group_id")
        groups = w.spark.createDataFrame([(r["group_id"],) for r in asked.toLocalIterator() if confirm(r["group_id"])], "group_id string")
        chosen = proposals.join(groups, "group_id", "left_semi")
    else:
        chosen = proposals
    records = w.write(journals.apply_proposals(w.read("records"), chosen, issn), "records")
    w.write(journals.mark_applied(proposals, issn, groups), "journals")
    return records


def run_dedup(w: Workspace, by: str = "dc_identifier_doi", fuzzy: bool = True, dry_run: bool = False) -> DataFrame:
    """Links, merge plan and flags of one snapshot; unless ``dry_run`` the plan is carried out and the history appended."""
    records = w.read("records")
    exact = dedup.exact_members(records, by).select("kept_id", F.col("resource_id").alias("deleted_id"))
    content = dedup.survivor(dedup.content_links(records, w.settings), records)
    first = exact.withColumn("phase", F.lit(0)).unionByName(content.select("kept_id", "deleted_id").withColumn("phase", F.lit(1)))
    actions = first.groupBy("kept_id", "deleted_id").agg(F.min("phase").alias("phase")).withColumn("seq", F.struct("phase", "kept_id", "deleted_id"))
    plan = w.write(dedup.plan_merges(actions.select("seq", "kept_id", "deleted_id")), "merge_plan")
    links = content.select("id_a", "id_b", "match_type", "score")
    if fuzzy:
        links = links.unionByName(dedup.fuzzy_links(records, w.settings))
    w.write(dedup.duplicate_flags(links, records), "dedup_flags")
    if not dry_run:
        kept, history = dedup.merge_records(records, plan)
        history = snapshots.with_audit(history.withColumn("dedup_merged_at", F.current_timestamp()).join(actions_of(first, content), ["dedup_kept_resource_id", "dedup_other_resource_id"], "left"))
        past = w.read("history") if w.has("history") else None
        w.write(history if past is None else snapshots.with_columns(past, history), "history")
        w.write(kept, "records")
    return plan


def actions_of(first: DataFrame, content: DataFrame) -> DataFrame:
    """Type and score of each planned merge, for the history."""
    scored = content.groupBy(F.col("kept_id").alias("dedup_kept_resource_id"), F.col("deleted_id").alias("dedup_other_resource_id")).agg(F.max(F.struct("score", "match_type")).alias("x"))
    every = first.select(F.col("kept_id").alias("dedup_kept_resource_id"), F.col("deleted_id").alias("dedup_other_resource_id")).distinct().join(scored, ["dedup_kept_resource_id", "dedup_other_resource_id"], "left")
    return every.select("dedup_kept_resource_id", "dedup_other_resource_id", F.coalesce("x.match_type", F.lit("exact")).alias("dedup_match_type"), F.coalesce("x.score", F.lit(1.0)).alias("dedup_match_score"))


COMMANDS: dict[str, Callable[[Workspace, argparse.Namespace], DataFrame]] = {
    "bootstrap-local-db": lambda w, a: bootstrap(w, a.source, a.drop, a.limit),
    "setup-processing-queue": lambda w, a: init_stage_outputs(w),
    "validate-metadata": lambda w, a: run_validation(w, a.status, a.limit, a.revalidate),
    "apply-validation-fixes": lambda w, a: run_fixes(w, a.preview),
    "metadata-validation-status": lambda w, a: validate.status_counts(w.read("validation")),
    "detect-authors": lambda w, a: run_authors(w),
    "detect-authors-llm": lambda w, a: run_authors_completion(w, named(a.completer, "--completer")),
    "compare-author-detection": lambda w, a: authors.compare_sets(w.read("authors").join(w.read("records"), "resource_id"), "names", "utb_contributor_internalauthor"),
    "author-detection-status": lambda w, a: w.read("authors").select(F.when(F.col("names").isNull(), "no_authors").otherwise("processed").alias("status")).groupBy("status").count(),
    "extract-dates": lambda w, a: run_dates(w),
    "extract-dates-llm": lambda w, a: run_dates_completion(w, named(a.completer, "--completer")),
    "date-extraction-status": lambda w, a: dates.date_status(w.read("dates")),
    "setup-dedup-history": lambda w, a: w.read("history") if w.has("history") else w.write(w.read("records").limit(0), "history"),
    "deduplicate-records": lambda w, a: run_dedup(w, a.by, not a.no_fuzzy, a.dry_run),
    "deduplication-status": lambda w, a: w.read("merge_plan").groupBy().count(),
    "normalize-journals": lambda w, a: run_journals(w, {p: named(spec, "--lookup") for p, _, spec in (x.partition("=") for x in a.lookup)}),
    "apply-journal-normalization": lambda w, a: run_journal_apply(w, a.issn, ask_user if a.interactive else None, a.preview),
    "journal-normalization-status": lambda w, a: validate.status_counts(w.read("journals")),
}


def named(spec: str | None, what: str):
    """The object that ``module:name`` stands for; nothing is called online unless it is named."""
    if not spec:
        raise SystemExit(f"this command needs {what} as module:name")
    module, _, name = spec.partition(":")
    return getattr(import_module(module), name)


def ask_user(group: str) -> bool:
    """Confirmation of one group at the terminal."""
    return input(f"apply the proposals of {group}? [y/N] ").strip().lower() == "y"


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> DataFrame:
    """Runs one command; its result is shown and returned."""
    p = argparse.ArgumentParser(prog="scriptorium")
    p.add_argument("command", choices=sorted(COMMANDS))
    p.add_argument("--workspace", required=True)
    p.add_argument("--source")
    p.add_argument("--limit", type=int)
    p.add_argument("--by", default="dc_identifier_doi", choices=dedup.ALLOWED_COLUMNS)
    p.add_argument("--threshold", type=float)
    p.add_argument("--issn")
    p.add_argument("--status", action="append", help="statuses that are due")
    p.add_argument("--completer", help="module:name of a function from prompt to answer")
    p.add_argument("--lookup", action="append", default=[], help="provider=module:name of a function from key to (publisher, journal)")
    for flag in ("drop", "preview", "dry-run", "no-fuzzy", "interactive", "revalidate"):
        p.add_argument(f"--{flag}", action="store_true")
    args = p.parse_args(argv)
    settings = Settings.from_env()
    if args.threshold:
        settings = Settings(**{**settings.__dict__, "fuzzy_title_threshold": args.threshold})
    out = COMMANDS[args.command](Workspace(spark or SparkSession.builder.getOrCreate(), args.workspace, settings), args)
    out.show(20, truncate=60)
    return out


if __name__ == "__main__":
    main()
