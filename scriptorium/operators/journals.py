"""Canonical journal and publisher of groups of records that share an ISSN or ISBN."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from scriptorium.functions import text as X


def journal_groups(records: DataFrame) -> DataFrame:
    """``resource_id, id_kind, group_id, publisher, journal, tier``: grouped by the first ISSN, else the first ISBN.

    ``tier`` 0 for rows with a Scopus affiliation, 1 with a WoS one, 2 for the rest. Rows without an id have a null group.
    """
    issn, isbn = F.try_element_at(X.parse_issns(F.col("dc_identifier_issn")), F.lit(1)), F.try_element_at(X.parse_isbns(F.col("dc_identifier_isbn")), F.lit(1))
    has = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    return records.select(
        "resource_id", F.when(issn.isNotNull(), "issn").when(isbn.isNotNull(), "isbn").alias("id_kind"), F.coalesce(issn, isbn).alias("group_id"),
        "dc_publisher", "dc_relation_ispartof", X.first_non_empty(F.col("dc_publisher")).alias("publisher"), X.first_non_empty(F.col("dc_relation_ispartof")).alias("journal"),
        F.when(has("utb_scopus_affiliation"), 0).when(has("utb_wos_affiliation"), 1).otherwise(2).alias("tier"),
    )


def canonical_values(groups: DataFrame, value: str) -> DataFrame:
    """``id_kind, group_id, value``: the most frequent value of the first tier that has one; of equals the one seen first.

    Counts are partial before they are shuffled, so a journal that holds a third of the rows costs no more.
    """
    counted = groups.filter(F.col("group_id").isNotNull() & F.col(value).isNotNull()).groupBy("id_kind", "group_id", "tier", value).agg(F.count("*").alias("n"), F.min("resource_id").alias("first"))
    return counted.groupBy("id_kind", "group_id").agg(F.min_by(value, F.struct("tier", -F.col("n"), "first")).alias(value))


# For each kind of group the kinds of keys in the order in which they are asked, with their providers in order.
CASCADE = {"issn": (("doi", ("crossref",)), ("issn", ("crossref", "openalex"))), "isbn": (("doi", ("crossref",)), ("isbn", ("google", "openlibrary")))}
# Providers whose answer counts without a journal title, too.
PUBLISHER_IS_ENOUGH = ("crossref",)


def lookup_keys(records: DataFrame) -> DataFrame:
    """``id_kind, group_id, key_kind, provider, key, step, pos, rank``: what is asked for each group, in the order of the cascade.

    A key of a group is asked once: at its place in the first record that has it (by ``resource_id``).
    """
    groups = journal_groups(records).select("resource_id", "id_kind", "group_id").filter("group_id is not null")
    dois = F.filter(F.transform(F.coalesce("dc_identifier_doi", F.array().cast("array<string>")), lambda x: F.lower(X.clean_doi(x))), lambda x: x != "")
    values = records.select("resource_id", dois.alias("doi"), X.parse_issns(F.col("dc_identifier_issn")).alias("issn"), X.parse_isbns(F.col("dc_identifier_isbn")).alias("isbn"))
    rows = groups.join(values, "resource_id")
    asked = [
        F.transform(F.col(kind), (lambda kind, step: lambda x, i: F.struct(F.lit(kind).alias("key_kind"), F.lit(step).alias("step"), i.alias("place"), x.alias("key")))(kind, step)).alias(f"{group}_{step}")
        for group, steps in CASCADE.items() for step, (kind, _) in enumerate(steps)
    ]
    none = F.array().cast("array<struct<key_kind:string,step:int,place:int,key:string>>")
    wide = rows.select("resource_id", "id_kind", "group_id", *asked)
    listed = F.when(F.col("id_kind") == "issn", F.concat(*[F.coalesce(f"issn_{k}", none) for k in range(2)])).otherwise(F.concat(*[F.coalesce(f"isbn_{k}", none) for k in range(2)]))
    flat = wide.select("resource_id", "id_kind", "group_id", F.inline(listed))
    once = flat.groupBy("id_kind", "group_id", "key_kind", "step", "key").agg(F.min(F.struct("resource_id", "place")).alias("pos"))
    providers = F.array(*[F.struct(F.lit(g).alias("g"), F.lit(k).alias("k"), F.lit(r).alias("rank"), F.lit(name).alias("provider")) for g, steps in CASCADE.items() for k, names in steps for r, name in enumerate(names)])
    mine = F.filter(providers, lambda x: (x["g"] == F.col("id_kind")) & (x["k"] == F.col("key_kind")))
    return once.select("id_kind", "group_id", "key_kind", "key", "step", "pos", F.explode(mine).alias("x")).select("id_kind", "group_id", "key_kind", "x.provider", "key", "step", "pos", "x.rank")


def looked_up(keys: DataFrame, answers: DataFrame) -> DataFrame:
    """``id_kind, group_id, publisher, journal, provider``: the first answer of the cascade for each group.

    ``keys`` as of :func:`lookup_keys`; ``answers``: ``provider, key, publisher, journal``. An answer counts if it has a
    journal title; one of ``PUBLISHER_IS_ENOUGH`` also with a publisher alone.
    """
    told = answers.select("provider", F.lower("key").alias("key"), *[F.nullif(X.utrim(F.col(c)), F.lit("")).alias(c) for c in ("publisher", "journal")])
    told = told.filter(F.col("journal").isNotNull() | (F.col("publisher").isNotNull() & F.col("provider").isin(*PUBLISHER_IS_ENOUGH)))
    hits = keys.join(told, ["provider", "key"])
    first = hits.groupBy("id_kind", "group_id").agg(F.min_by(F.struct("publisher", "journal", "provider"), F.struct("step", "pos", "rank", "publisher", "journal")).alias("x"))
    return first.select("id_kind", "group_id", "x.publisher", "x.journal", "x.provider")


def propose(records: DataFrame, lookup: DataFrame | None = None) -> DataFrame:
    """``resource_id, group_id, proposed_publisher, proposed_journal, status``.

    A value is proposed where the record's distinct values aren't exactly the canonical one. Status ``has_proposal`` or
    ``no_change``; rows without an id never change.
    """
    groups = journal_groups(records)
    canon = canonical_values(groups, "publisher").withColumnRenamed("publisher", "p").join(canonical_values(groups, "journal").withColumnRenamed("journal", "j"), ["id_kind", "group_id"], "full")
    if lookup is not None:
        found = looked_up(lookup_keys(records), lookup).select("id_kind", "group_id", F.col("publisher").alias("lp"), F.col("journal").alias("lj"))
        canon = canon.join(found, ["id_kind", "group_id"], "left").select("id_kind", "group_id", F.coalesce("lp", "p").alias("p"), F.coalesce("lj", "j").alias("j"))
    rows = groups.join(canon, ["id_kind", "group_id"], "left")
    need = lambda c, values: F.when(F.col(c).isNotNull() & ~F.coalesce(F.array_distinct(values) == F.array(c), F.lit(False)), F.col(c))
    out = rows.select("resource_id", "group_id", need("p", F.col("dc_publisher")).alias("proposed_publisher"), need("j", F.col("dc_relation_ispartof")).alias("proposed_journal"))
    return out.withColumn("status", F.when(F.col("proposed_publisher").isNotNull() | F.col("proposed_journal").isNotNull(), "has_proposal").otherwise("no_change"))


def apply_proposals(records: DataFrame, proposals: DataFrame, issn: str | None = None) -> DataFrame:
    """New version of ``records`` with the proposed values, of one group only if ``issn`` is given."""
    chosen = proposals if issn is None else proposals.filter(F.col("group_id") == issn.lower())
    p = chosen.select("resource_id", "proposed_publisher", "proposed_journal")
    out = records.join(p, "resource_id", "left")
    swap = {"dc_publisher": "proposed_publisher", "dc_relation_ispartof": "proposed_journal"}
    return out.withColumns({c: F.coalesce(F.when(F.col(q).isNotNull(), F.array(q)), F.col(c)) for c, q in swap.items()}).select(*records.columns)


def set_status(proposals: DataFrame, status: str, chosen: DataFrame) -> DataFrame:
    """``proposals`` with ``status`` for the records ``chosen`` (``resource_id``)."""
    mark = chosen.select("resource_id").distinct().withColumn("__s", F.lit(status))
    return proposals.join(mark, "resource_id", "left").withColumn("status", F.coalesce("__s", "status")).drop("__s")


def mark_applied(proposals: DataFrame, issn: str | None = None, groups: DataFrame | None = None) -> DataFrame:
    """``proposals`` with status ``applied`` where one was written: of one group, of confirmed ``groups`` (``group_id``), or of all."""
    done = proposals.filter("status = 'has_proposal'")
    done = done if issn is None else done.filter(F.col("group_id") == issn.lower())
    done = done if groups is None else done.join(groups.select("group_id").distinct(), "group_id", "left_semi")
    return set_status(proposals, "applied", done)


def group_report(records: DataFrame) -> DataFrame:
    """``group_id, value, n``: how often each journal title stands in each group."""
    return journal_groups(records).filter("group_id is not null and journal is not null").groupBy("group_id", F.col("journal").alias("value")).agg(F.count("*").alias("n"))


def top_proposals(proposals: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` groups with the most proposals (a report)."""
    return proposals.filter("status = 'has_proposal'").groupBy("group_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "group_id").limit(n)


def limit_groups(proposals: DataFrame, n: int) -> DataFrame:
    """Proposals of the first ``n`` groups; rows without a group always stay."""
    ids = proposals.select("group_id").filter("group_id is not null").distinct().orderBy("group_id").limit(n)
    return proposals.join(ids, "group_id", "left_semi").unionByName(proposals.filter("group_id is null"))


