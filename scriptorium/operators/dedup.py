"""Finding, planning and merging duplicate records."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from scriptorium.functions import text as X
from scriptorium.functions.similarity import jaro_winkler_udf, may_reach, similar_pairs
from scriptorium.plans.lineage import reliable
from scriptorium.settings import Settings

ALLOWED_COLUMNS = ("dc_identifier_doi", "dc_identifier_isbn", "utb_identifier_wok", "utb_identifier_scopus", "utb_identifier_obdid")
UNION_COLUMNS = ("dc_contributor_author", "dc_identifier_doi", "dc_identifier_issn", "dc_identifier_isbn", "dc_type", "utb_source", "utb_identifier_wok", "utb_identifier_scopus", "utb_identifier_obdid", "utb_wos_affiliation", "utb_scopus_affiliation")
FILL_COLUMNS = ("dc_title", "dc_description_abstract", "dc_date_issued", "dc_publisher", "dc_relation_ispartof", "dc_citation_spage", "dc_citation_epage", "utb_relation_volume", "utb_relation_issue", "utb_fulltext_affiliation", "utb_fulltext_dates")


def exact_groups(records: DataFrame, column: str) -> DataFrame:
    """``value, kept_id, n``: values of an allowed column that several records share.

    Grouping counts before it shuffles and gathers no ids. Null and empty values make no group.
    """
    if column not in ALLOWED_COLUMNS:
        raise ValueError(f"duplicates can't be found by {column!r}")
    value = X.value_form(F.col(column))
    return records.select("resource_id", value.alias("value")).filter("value <> ''").groupBy("value").agg(F.min("resource_id").alias("kept_id"), F.count("*").alias("n")).filter("n > 1")


def exact_members(records: DataFrame, column: str) -> DataFrame:
    """``value, kept_id, resource_id`` of every other member of a group."""
    groups = exact_groups(records, column)
    rows = records.select("resource_id", X.value_form(F.col(column)).alias("value"))
    return rows.join(groups.select("value", "kept_id"), "value").filter("resource_id <> kept_id").select("value", "kept_id", "resource_id")


def _digest(text: Column) -> Column:
    """16 bytes that stand for a text."""
    return F.unhex(F.md5(text))


def _comparable(records: DataFrame) -> DataFrame:
    present = lambda c: F.coalesce(X.utrim(F.col(c)) != "", F.lit(False))
    return records.select(
        "resource_id",
        X.title_form(X.utrim(F.try_element_at("dc_title", F.lit(1)))).alias("title"),
        _digest(X.authors_form(F.coalesce("dc_contributor_author", F.array().cast("array<string>")))).alias("authors"),
        _digest(X.normalise(F.try_element_at("dc_description_abstract", F.lit(1)))).alias("abstract"),
        F.coalesce(X.issn_form(F.try_element_at("dc_identifier_issn", F.lit(1))), F.lit("")).alias("issn"),
        F.coalesce(X.value_form(F.col("dc_type")), F.lit("")).alias("doctype"),
        (present("utb_relation_volume") | present("utb_relation_issue")).alias("pages"),
    )


def content_links(records: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``id_a, id_b, match_type, score``: links between records of one publication by title and content.

    Title similarity at least 0.96, authors and abstracts equal where both have them, and at least one of authors,
    abstracts and ISSN equal. Records equal in all of these are one class: its smallest id is linked with each other
    member, and classes are linked through their smallest ids. Candidates share a title key *and* a piece of equal
    evidence, so no common title beginning or hot journal alone makes pairs; the similarity is computed last.

    Authors and abstracts are compared by digest, and candidates meet as two numbers, so no text is sent once for each key.
    """
    empty = _digest(F.lit(""))
    alike = ["title", "authors", "abstract", "issn", "doctype", "pages"]
    some = (F.col("title") != "") & ((F.col("authors") != empty) | (F.col("abstract") != empty) | (F.col("issn") != ""))
    # What can't be linked is a class of its own here, so it makes no hot group; it leaves after the cut, as a filter before
    # it would compute the forms once more.
    same = F.when(some, _digest(F.to_json(F.struct(*alike)))).otherwise(_digest(F.col("resource_id").cast("string")))
    rows = _comparable(records).withColumn("same", same).withColumn("rep", F.min("resource_id").over(Window.partitionBy("same"))).drop("same")
    rows = reliable(rows).filter(some)
    inner = rows.filter("resource_id <> rep")
    inner = inner.select(F.col("rep").alias("id_a"), F.col("resource_id").alias("id_b"), F.when(F.col("issn") != "", "exact:content").otherwise("autoplagiat").alias("match_type"), F.lit(1.0).alias("score"))
    classes = rows.filter("resource_id = rep")

    # Equal ISSNs decide only where authors and abstracts can't both be compared. A class takes part in such pairs as one
    # side or the other by what it lacks, so complete records of a hot journal never meet each other through it.
    lacks = F.when((F.col("authors") == empty) & (F.col("abstract") == empty), "both").when(F.col("authors") == empty, "authors").when(F.col("abstract") == empty, "abstract").otherwise("nothing")
    left_roles = {"nothing": ["nothing~both"], "authors": ["authors~abstract", "authors~both"], "abstract": ["abstract~both"], "both": ["both~both"]}
    right_roles = {"both": ["nothing~both", "authors~both", "abstract~both", "both~both"], "abstract": ["authors~abstract"]}

    def meeting(roles: dict[str, list[str]], side: str) -> DataFrame:
        """``k, rep``: a number for each title key with each piece of evidence."""
        texts = F.array(*[F.when(F.col(c) != empty, F.xxhash64(F.lit(c), c)) for c in ("authors", "abstract")])
        part = F.array().cast("array<string>")
        for what, names in roles.items():
            part = F.when(lacks == what, F.array(*map(F.lit, names))).otherwise(part)
        issn = F.when(F.col("issn") != "", F.transform(part, lambda r: F.xxhash64(r, F.col("issn")))).otherwise(F.array().cast("array<bigint>"))
        keyed = classes.select("rep", F.explode(X.title_keys(F.col("title"))).alias("k"), F.array_compact(F.concat(texts, issn)).alias("e"))
        return keyed.select(F.col("rep").alias(f"rep_{side}"), "k", F.explode("e").alias("e")).select(F.xxhash64("k", "e").alias("k"), f"rep_{side}")

    met = meeting(left_roles, "a").join(meeting(right_roles, "b"), "k").filter("rep_a <> rep_b").select(F.least("rep_a", "rep_b").alias("rep_a"), F.greatest("rep_a", "rep_b").alias("rep_b")).distinct()
    pairs = met.join(classes.select(*[F.col(c).alias(f"{c}_a") for c in ("rep", *alike)]), "rep_a").join(classes.select(*[F.col(c).alias(f"{c}_b") for c in ("rep", *alike)]), "rep_b")
    both_or = lambda c: (F.col(f"{c}_a") == empty) | (F.col(f"{c}_b") == empty) | (F.col(f"{c}_a") == F.col(f"{c}_b"))
    shared = lambda c, none: (F.col(f"{c}_a") != none) & (F.col(f"{c}_a") == F.col(f"{c}_b"))
    same_issn = shared("issn", F.lit(""))
    pairs = pairs.filter(both_or("authors") & both_or("abstract") & (shared("authors", empty) | shared("abstract", empty) | same_issn))
    pairs = pairs.filter((F.col("title_a") == F.col("title_b")) | may_reach(F.col("title_a"), F.col("title_b"), settings.content_title_threshold))
    scored = pairs.withColumn("score", jaro_winkler_udf("title_a", "title_b")).filter(F.col("score") >= settings.content_title_threshold)
    kinds = F.array_sort(F.array("doctype_a", "doctype_b")) == F.array(F.lit("article"), F.lit("conferenceobject"))
    kind = F.when(same_issn & (F.col("pages_a") != F.col("pages_b")), "early_access").when(~same_issn & kinds, "merged_type").when(~same_issn, "autoplagiat").otherwise("exact:content")
    between = scored.select(F.col("rep_a").alias("id_a"), F.col("rep_b").alias("id_b"), kind.alias("match_type"), F.round("score", 4).alias("score"))
    return inner.unionByName(between)


FUZZY_PART = 8192  # classes


def fuzzy_links(records: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``id_a, id_b, match_type, score``: links between records with similar titles at most a year apart.

    Records with equal title, year, ISSN and ISBN are one class, linked as in :func:`content_links`. The classes of a year
    are dealt into parts of at most about ``FUZZY_PART``; each pair of parts of one year or of two successive years is one
    group, in which all pairs are compared by :func:`similar_pairs`. Records without a year are compared among themselves.
    """
    rows = records.select(
        "resource_id", X.title_form(X.utrim(F.try_element_at("dc_title", F.lit(1)))).alias("title"), X.year_of(F.try_element_at("dc_date_issued", F.lit(1))).alias("year"),
        F.coalesce(X.issn_form(F.try_element_at("dc_identifier_issn", F.lit(1))), F.lit("")).alias("issn"), F.coalesce(X.issn_form(F.try_element_at("dc_identifier_isbn", F.lit(1))), F.lit("")).alias("isbn"),
    ).filter("title <> ''")
    rows = rows.withColumn("year", F.coalesce("year", F.lit(-1)))
    alike = ["title", "year", "issn", "isbn"]
    classes = rows.groupBy(*alike).agg(F.min("resource_id").alias("rep"), F.count("*").alias("n"))
    kind = lambda issn, isbn: F.when(issn, "fuzzy_title+issn").when(isbn, "fuzzy_title+isbn").otherwise("fuzzy_title")
    inner = rows.join(classes.filter("n > 1"), alike).filter("resource_id <> rep").select(F.col("rep").alias("id_a"), F.col("resource_id").alias("id_b"), kind(F.col("issn") != "", F.col("isbn") != "").alias("match_type"), F.lit(1.0).alias("score"))
    n = F.col("count")
    parts = classes.groupBy("year").count().select("year", F.greatest(F.ceil(n / FUZZY_PART), F.when(n > 1000, 2).otherwise(1)).cast("int").alias("parts"))
    near = [parts.select((F.col("year") + shift).alias("year"), F.col("parts").alias(name)) for shift, name in ((0, "own"), (1, "before"), (-1, "after"))]
    dealt = classes.join(F.broadcast(near[0]), "year").join(F.broadcast(near[1]), "year", "left").join(F.broadcast(near[2]), "year", "left")
    part = F.pmod(F.xxhash64("rep"), "own").cast("int")
    upto = lambda c: F.when(F.col(c) > 0, F.sequence(F.lit(0), F.col(c) - 1)).otherwise(F.array().cast("array<int>"))
    group = lambda year, i, other, j, left: F.struct(year.alias("year_a"), i.alias("part_a"), other.alias("year_b"), j.alias("part_b"), left.alias("left"))
    year = F.col("year")
    groups = F.concat(
        F.transform(upto("own"), lambda j: group(year, F.least("part", j), year, F.greatest("part", j), F.col("part") <= j)),
        F.transform(upto("after"), lambda j: group(year, F.col("part"), year + 1, j, F.lit(True))), F.transform(upto("before"), lambda j: group(year - 1, j, year, F.col("part"), F.lit(False))),
    )
    key = ["year_a", "part_a", "year_b", "part_b"]
    sent = dealt.withColumn("part", part).select("rep", "title", "issn", "isbn", F.explode(groups).alias("g")).select("rep", "title", "issn", "isbn", "g.*")
    spread = max(200, int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # few bytes, much work: not joined into larger tasks
    threshold = settings.fuzzy_title_threshold

    def compare(found: pa.Table) -> pa.Table:
        left, rep = found.column("left").to_numpy(), found.column("rep").to_numpy()
        one = found.column("year_a")[0] == found.column("year_b")[0] and found.column("part_a")[0] == found.column("part_b")[0]
        a, b, score = similar_pairs(found.column("title").to_pylist(), np.flatnonzero(left), None if one else np.flatnonzero(~left), rep, threshold)
        text = {c: np.array(found.column(c).to_pylist(), object) for c in ("issn", "isbn")}
        equal = {c: (x[a] != "") & (x[a] == x[b]) for c, x in text.items()}
        return pa.table({"id_a": rep[a], "id_b": rep[b], "issn": pa.array(equal["issn"].astype(bool)), "isbn": pa.array(equal["isbn"].astype(bool)), "score": score})

    scored = sent.repartition(spread, *key).groupBy(*key).applyInArrow(compare, "id_a bigint, id_b bigint, issn boolean, isbn boolean, score double")
    between = scored.select("id_a", "id_b", kind(F.col("issn"), F.col("isbn")).alias("match_type"), F.round("score", 4).alias("score"))
    return inner.unionByName(between)


def survivor(links: DataFrame, records: DataFrame) -> DataFrame:
    """``links`` with ``kept_id, deleted_id``: early access keeps the paginated record, merged types the article, others the smaller id."""
    facts = records.select("resource_id", (F.coalesce(X.utrim(F.col("utb_relation_volume")) != "", F.lit(False)) | F.coalesce(X.utrim(F.col("utb_relation_issue")) != "", F.lit(False))).alias("pages"), (X.value_form(F.col("dc_type")) == "article").alias("article"))
    a = facts.select(F.col("resource_id").alias("id_a"), F.col("pages").alias("pages_a"), F.col("article").alias("article_a"))
    b = facts.select(F.col("resource_id").alias("id_b"), F.col("pages").alias("pages_b"), F.col("article").alias("article_b"))
    rows = links.join(a, "id_a").join(b, "id_b")
    second = ((F.col("match_type") == "early_access") & F.col("pages_b") & ~F.col("pages_a")) | ((F.col("match_type") == "merged_type") & F.coalesce("article_b", F.lit(False)) & ~F.coalesce("article_a", F.lit(False)))
    low, high = F.least("id_a", "id_b"), F.greatest("id_a", "id_b")
    special = F.col("match_type").isin("early_access", "merged_type")
    kept = F.when(special, F.when(second, F.col("id_b")).otherwise(F.col("id_a"))).otherwise(low)
    return rows.select("id_a", "id_b", "match_type", "score", kept.alias("kept_id"), F.when(kept == low, high).otherwise(low).alias("deleted_id"))


def plan_fold(actions: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ordered (keep, delete) actions with earlier merges taken into account: each record is deleted at most once."""
    to: dict[int, int] = {}

    def target(x: int) -> int:
        seen = set()
        while x in to and x not in seen:
            seen.add(x)
            x = to[x]
        return x

    out = []
    for keep, gone in actions:
        k, d = target(keep), target(gone)
        if k == d:
            continue
        if d != gone and k == keep:  # the record to delete was merged already: its survivor keeps
            k, d = d, k
        elif d != gone and k != keep:
            k, d = min(k, d), max(k, d)
        out.append((k, d))
        to[d] = k
        if gone != k:
            to[gone] = k
    return out


def plan_merges(actions: DataFrame) -> DataFrame:
    """``seq, kept_id, deleted_id, component``: the fold of ordered ``actions`` (``seq, kept_id, deleted_id``).

    Actions of one connected set of records are folded together in order of ``seq``; sets are folded apart from each other.
    Only a set's ids are held by a task, never its records. The actions are found once, not once for each use.
    """
    actions = reliable(actions.select("seq", "kept_id", "deleted_id"))
    nodes = components(actions.select("kept_id", "deleted_id"), "kept_id", "deleted_id")
    rows = actions.join(nodes, actions["kept_id"] == nodes["node"]).select("seq", "kept_id", "deleted_id", "component")

    def fold(group: pa.Table) -> pa.Table:
        group = group.sort_by("seq")
        planned = plan_fold(list(zip(group.column("kept_id").to_pylist(), group.column("deleted_id").to_pylist())))
        return pa.table({
            "seq": pa.array(range(len(planned)), pa.int64()), "kept_id": pa.array([k for k, _ in planned], pa.int64()),
            "deleted_id": pa.array([d for _, d in planned], pa.int64()), "component": pa.array([group.column("component")[0].as_py()] * len(planned), pa.int64()),
        })

    return rows.groupBy("component").applyInArrow(fold, "seq bigint, kept_id bigint, deleted_id bigint, component bigint")


MAX_ROUNDS = 60


def components(edges: DataFrame, a: str, b: str, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """``node, component`` (smallest node) of the undirected ``edges``.

    Each round links the neighbours above a node to the least one it knows, then halves the way of every node to its
    least; chains shrink by half, so rounds are about the logarithm of the longest. An error if ``max_rounds`` don't do.
    """
    raw = edges.select(F.col(a).cast("bigint").alias("u"), F.col(b).cast("bigint").alias("v")).filter("u is not null and v is not null")
    nodes = raw.select(F.col("u").alias("node")).unionByName(raw.select(F.col("v").alias("node"))).distinct()
    links = reliable(raw.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        around = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        upward = around.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        below = upward.groupBy("u").agg(F.min("v").alias("m"))
        moved = upward.join(below, "u")
        links = reliable(moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(moved.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components haven't settled after {max_rounds} rounds")
    found = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def merge_records(records: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new records, history): survivors with merged values, deleted records gone, both copies kept in the history.

    Union columns join the values of the survivor and then, in order of the plan, of those merged into it, once each;
    fill columns take the first that isn't empty. Actions on records that aren't there are left out.
    """
    there = records.select("resource_id")
    live = plan.join(there.withColumnRenamed("resource_id", "kept_id"), "kept_id", "left_semi").join(there.withColumnRenamed("resource_id", "deleted_id"), "deleted_id", "left_semi")
    live = reliable(live)  # five uses; the plan and what it comes from are computed once
    final = live.join(live.select(F.col("deleted_id").alias("kept_id")).distinct(), "kept_id", "left_anti")
    roots = components(live, "kept_id", "deleted_id")
    top = final.select("kept_id").distinct().join(roots, F.col("kept_id") == F.col("node")).select(F.col("kept_id").alias("root"), "component")
    members = roots.join(top, "component").select(F.col("node").alias("resource_id"), "root")
    order = live.groupBy(F.col("deleted_id").alias("resource_id")).agg((F.min("seq") + 1).alias("order"))
    rows = records.join(members, "resource_id").join(order, "resource_id", "left").withColumn("order", F.when(F.col("resource_id") == F.col("root"), F.lit(0)).otherwise(F.coalesce("order", F.lit(1))))
    unions = [c for c in UNION_COLUMNS if c in records.columns]
    fills = [c for c in FILL_COLUMNS if c in records.columns]
    types = dict(records.dtypes)
    empty = lambda c: (F.coalesce(F.size(F.filter(c, lambda x: X.utrim(x) != "")), F.lit(0)) == 0) if types[c].startswith("array") else (F.coalesce(X.utrim(F.col(c)), F.lit("")) == "")
    merged = rows.groupBy("root").agg(
        *[F.transform(F.array_sort(F.collect_list(F.struct("order", "resource_id", F.coalesce(c, F.array().cast("array<string>")).alias("x")))), lambda s: s["x"]).alias(c) for c in unions],
        *[F.min_by(c, F.when(~empty(c), F.struct("order", "resource_id"))).alias(c) for c in fills],
    )
    merged = merged.select(F.col("root").alias("resource_id"), *[X.merge_ordered(F.flatten(c), F.array().cast("array<string>")).alias(f"__{c}") for c in unions], *[F.col(c).alias(f"__{c}") for c in fills])
    survivors = records.join(merged, "resource_id", "left").withColumns({c: F.coalesce(F.when(F.size(f"__{c}") > 0, F.col(f"__{c}")) if c in unions else F.col(f"__{c}"), F.col(c)) for c in (*unions, *fills)}).select(*records.columns)
    survivors = survivors.join(live.select(F.col("deleted_id").alias("resource_id")).distinct(), "resource_id", "left_anti")
    audit = live.select("kept_id", "deleted_id", F.explode(F.array("kept_id", "deleted_id")).alias("resource_id"))
    history = records.join(audit, "resource_id").withColumnsRenamed({"kept_id": "dedup_kept_resource_id", "deleted_id": "dedup_other_resource_id"})
    return survivors, history


def duplicate_flags(links: DataFrame, live: DataFrame) -> DataFrame:
    """``resource_id, duplicates``: the links of each record in both directions as JSON, and whether the other record is live."""
    both = links.select(F.col("id_a").alias("resource_id"), F.col("id_b").alias("other"), "match_type", "score").unionByName(links.select(F.col("id_b").alias("resource_id"), F.col("id_a").alias("other"), "match_type", "score"))
    known = live.select(F.col("resource_id").alias("other"), F.lit(True).alias("is_live"))
    rows = both.join(known, "other", "left").withColumn("is_live", F.coalesce("is_live", F.lit(False)))
    return rows.groupBy("resource_id").agg(F.to_json(F.array_sort(F.collect_set(F.struct("other", "match_type", "score", "is_live")))).alias("duplicates"))


def link_counts(links: DataFrame) -> DataFrame:
    """``match_type, n``."""
    return links.groupBy("match_type").agg(F.count("*").alias("n"))


def pair_count(groups: DataFrame) -> DataFrame:
    """``pairs``: how many pairs the exact groups stand for, without making them."""
    return groups.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0)).cast("bigint").alias("pairs"))
