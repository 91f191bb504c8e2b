"""Best representative of each duplicate group: components, latent two-sided quality, one survivor field by field.

Plan: components come from alternating large-star and small-star steps over the edges, each a join with one row per node
and cut by a reliable checkpoint, so a component of any size is never gathered. Each value that a member of a group
gives is a claim; the observers of a claim are the exports with a member in the group and a reader that knows the whole
corpus and speaks up for a value unless it looks like a stand-in, is cut off, abbreviated or of a wrong form. Expectation-maximisation infers each observer's sensitivity and specificity over claim patterns (claims observed
alike count together), and it alone judges: every value that is more likely true than not is retained. Nothing is
collected but the observers' figures.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from scriptorium.operators.dedup import components
from scriptorium.plans.lineage import reliable

ROUNDS = 8
#: EM ends when no figure of an observer moves by more than this.
SETTLED = 1e-3
MAX_OBSERVERS = 100_000
#: Sensitivity and specificity at the start. The four faults exclude each other, so they are one observer's, not four.
START = {"reader": (0.98, 0.95), "export": (0.6, 0.5)}
PRIOR = 0.7

# Texts that stand in for a missing publisher or volume, in lower case.
STAND_INS = (
    "", "-", "--", "–", "—", "?", "n/a", "na", "n.a.", "none", "null", "nil", "unknown", "not known", "not available", "not stated",
    "unspecified", "tba", "tbd", "s.n.", "[s.n.]", "s. n.", "[s. n.]", "sine nomine", "neznámý", "neznámé", "neuvedeno", "nezjištěno",
    "nezistené", "neznáme", "unbekannt", "o. a.", "k. a.", "in press", "online first", "early access", "ahead of print", "v tisku", "v tlači", "im druck", "forthcoming", "xx", "0",
)
# Words that abbreviations leave out.
LINKING = ("of", "and", "the", "for", "in", "a", "und", "der", "die", "das", "für", "et", "de", "la", "le", "a", "pro", "v")


def _plain(value: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(value, r"(?U)\s+", " ")))


def _words(value: Column) -> Column:
    """Words of a text, linking words left out."""
    return F.filter(F.split(F.regexp_replace(_plain(value), r"(?U)[^\w]+", " "), " "), lambda w: (w != "") & ~w.isin(*LINKING))


def shortened(values: DataFrame) -> DataFrame:
    """``value, is_prefix, is_abbreviation`` of distinct texts (``value, n``) against all others at least as frequent.

    A text is cut off if a longer one begins with it, abbreviated if word by word it begins the words of a longer one.
    """
    v = values.select("value", "n", _plain(F.col("value")).alias("plain"), _words(F.col("value")).alias("words")).filter("plain <> ''")
    longer = v.select(F.col("plain").alias("whole"), F.col("n").alias("n_whole"), F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("plain") - 1, F.lit(1))), lambda k: F.substring("plain", F.lit(1), k))).alias("plain"))
    cut = v.join(longer.filter("whole <> plain"), "plain").filter("n_whole >= n").select("value").distinct().withColumn("is_prefix", F.lit(True))
    initials = F.concat_ws("", F.transform("words", lambda w: F.substring(w, 1, 1)))
    keyed = v.filter(F.size("words") > 1).withColumn("initials", initials)
    # met by the initials and all that is written of the first two words, so common initials are no hot key
    written = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda k: F.substring(w, F.lit(1), k))
    full = keyed.select("initials", F.col("words").alias("whole"), F.col("n").alias("n_whole"), F.explode(written(F.col("words")[0])).alias("first"))
    full = full.select("initials", "whole", "n_whole", "first", F.explode(written(F.col("whole")[1])).alias("second"))
    keyed = keyed.withColumns({"first": F.col("words")[0], "second": F.col("words")[1]})
    fits = F.forall(F.zip_with("words", "whole", lambda a, b: b.startswith(a)), lambda x: x)
    abbreviated = keyed.join(full, ["initials", "first", "second"]).filter((F.col("n_whole") >= F.col("n")) & (F.size("words") == F.size("whole")) & (F.col("words") != F.col("whole")) & fits)
    abbreviated = abbreviated.select("value").distinct().withColumn("is_abbreviation", F.lit(True))
    out = values.select("value").join(cut, "value", "left").join(abbreviated, "value", "left")
    return out.select("value", F.coalesce("is_prefix", F.lit(False)).alias("is_prefix"), F.coalesce("is_abbreviation", F.lit(False)).alias("is_abbreviation"))


def infer_quality(patterns: DataFrame, rounds: int = ROUNDS) -> tuple[dict, dict]:
    """Sensitivity and specificity of each (field, observer) and the share of true claims of each field, by EM.

    ``patterns``: ``pattern, field, obs, n`` with ``obs`` an array of ``(observer, kind, said)``. What EM finds is kept off
    0 and 1 by a few made-up claims at the starting figures. Each round is one job: the sums of all observers.
    """
    told = patterns.select("field", F.explode("obs").alias("o")).select("field", "o.observer", "o.kind").distinct().limit(MAX_OBSERVERS + 1).collect()
    if len(told) > MAX_OBSERVERS:
        raise ValueError(f"more than {MAX_OBSERVERS} observers")
    kinds = {(r["field"], r["observer"]): r["kind"] for r in told}
    quality = {key: START[kind] for key, kind in kinds.items()}
    prior = {f: PRIOR for f, _ in quality}
    for _ in range(rounds if told else 0):
        flat = _posterior(patterns, quality, prior).select("field", "n", "p", F.explode("obs").alias("o"))
        sums = flat.groupBy("field", F.col("o.observer").alias("observer")).agg(
            F.sum(F.col("n") * F.col("p")).alias("true"), F.sum(F.col("n") * (1 - F.col("p"))).alias("false"),
            F.sum(F.when(F.col("o.said"), F.col("n") * F.col("p")).otherwise(0.0)).alias("said_true"), F.sum(F.when(~F.col("o.said"), F.col("n") * (1 - F.col("p"))).otherwise(0.0)).alias("kept_false"),
        ).collect()
        moved = 0.0
        for r in sums:
            key = (r["field"], r["observer"])
            weight = 20.0 if kinds[key] == "reader" else 5.0
            s, t = START[kinds[key]]
            after = (r["said_true"] + weight * s) / (r["true"] + weight), (r["kept_false"] + weight * t) / (r["false"] + weight)
            moved = max(moved, *(abs(x - y) for x, y in zip(after, quality[key])))
            quality[key] = after
            if kinds[key] == "reader":  # it hears every claim of the field
                prior[r["field"]] = min(0.99, max(0.01, r["true"] / (r["true"] + r["false"])))
        if moved < SETTLED:
            break
    return quality, prior


def _posterior(patterns: DataFrame, quality: dict, prior: dict) -> DataFrame:
    """``patterns`` with ``p``, the probability that such a claim is true."""
    spark = patterns.sparkSession
    rows = [(f, o, math.log(s / (1 - t)), math.log((1 - s) / t), math.log(prior[f] / (1 - prior[f]))) for (f, o), (s, t) in quality.items()]
    weights = spark.createDataFrame(rows or [("", "", 0.0, 0.0, 0.0)], "field string, observer string, yes double, no double, base double")
    flat = patterns.select("pattern", "field", F.explode("obs").alias("o")).select("pattern", "field", "o.observer", "o.said")
    said = F.when(F.col("said"), F.col("yes")).otherwise(F.col("no"))
    odds = flat.join(F.broadcast(weights), ["field", "observer"]).groupBy("pattern").agg((F.sum(said) + F.max("base")).alias("odds"))
    return patterns.join(odds, "pattern").withColumn("p", 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), F.col("odds")))))).drop("odds")


def true_values(members: DataFrame, corpus: DataFrame) -> DataFrame:
    """``component, resource_id, field, value, at, p`` of every value of every member, with the probability that it is true.

    ``members``: ``component, resource_id, source, at, publishers, volume``; ``corpus``: all texts ``field, value`` of the
    whole table, whose counts the tests use. Null values aren't claims. A field may keep several true values.
    """
    claims = members.select("component", "resource_id", "source", "at", F.inline(F.concat(
        F.transform(F.coalesce("publishers", F.array().cast("array<string>")), lambda x: F.struct(F.lit("publisher").alias("field"), x.alias("value"))),
        F.array(F.struct(F.lit("volume").alias("field"), F.col("volume").alias("value"))),
    ))).filter("value is not null")
    counts = corpus.filter("value is not null").groupBy("field", "value").agg(F.count("*").alias("n"))
    publishers = counts.filter("field = 'publisher'").select("value", "n")
    short = shortened(publishers)
    plain = _plain(F.col("value"))
    tests = counts.join(short, "value", "left").select(
        "field", "value",
        (~plain.isin(*STAND_INS) & plain.rlike(r"(?U)[\w]")).alias("no_stand_in"),
        ((F.col("field") != "publisher") | ~F.coalesce("is_prefix", F.lit(False))).alias("not_cut"),
        ((F.col("field") != "publisher") | ~F.coalesce("is_abbreviation", F.lit(False))).alias("not_abbreviated"),
        F.when(F.col("field") == "volume", F.coalesce(F.expr("try_cast(value as decimal(38,0))"), F.lit(0)) > 0).otherwise(plain.rlike(r"(?U)\p{L}{2}")).alias("right_form"),
    )
    facts = claims.groupBy("component", "field", "value").agg(F.collect_set("source").alias("says"))
    heard = claims.groupBy("component", "field").agg(F.collect_set("source").alias("sources"))
    reader = F.struct(F.lit("reader").alias("observer"), F.lit("reader").alias("kind"), (F.col("no_stand_in") & F.col("not_cut") & F.col("not_abbreviated") & F.col("right_form")).alias("said"))
    exports = F.transform(F.array_sort("sources"), lambda s: F.struct(F.concat(F.lit("export:"), s).alias("observer"), F.lit("export").alias("kind"), F.array_contains("says", s).alias("said")))
    facts = facts.join(heard, ["component", "field"]).join(tests, ["field", "value"])
    facts = facts.select("component", "field", "value", F.concat(F.array(reader), exports).alias("obs"))
    facts = reliable(facts.withColumn("pattern", F.xxhash64("field", F.to_json("obs"))))
    patterns = reliable(facts.groupBy("pattern", "field").agg(F.first("obs").alias("obs"), F.count("*").cast("double").alias("n")))
    quality, prior = infer_quality(patterns)
    judged = facts.join(_posterior(patterns, quality, prior).select("pattern", "p"), "pattern")
    return claims.join(judged.select("component", "field", "value", "p"), ["component", "field", "value"])


def judged_values(records: DataFrame, history: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups ``node, component``; claims as in :func:`true_values`) of the sets that ``history`` merges."""
    groups = components(history, "dedup_kept_resource_id", "dedup_other_resource_id")
    rows = records.select(
        F.col("resource_id").cast("bigint").alias("resource_id"), F.coalesce(F.array_join("utb_source", "+"), F.lit("")).alias("source"),
        F.expr("try_to_timestamp(try_element_at(dc_date_accessioned, 1))").alias("at"), F.col("dc_publisher").alias("publishers"), F.col("utb_relation_volume").alias("volume"),
    )
    members = groups.join(rows, groups["node"] == rows["resource_id"]).drop("node")
    corpus = records.select(F.lit("publisher").alias("field"), F.explode("dc_publisher").alias("value"))
    corpus = corpus.unionByName(members.select(F.lit("volume").alias("field"), F.col("volume").alias("value")))
    return groups, true_values(members, corpus)


def survivors(records: DataFrame, history: DataFrame) -> DataFrame:
    """``group_id, publisher_id, volume_id, publishers, volumes``: one surviving record of each merged set.

    Of the members whose value is judged true the one accessioned last gives the field (of equals the smaller id);
    ``publishers`` and ``volumes`` retain every value judged true. A set without a true value has a null there. Null ids are
    left out, repeated merges count once, an empty log gives an empty result, a member that isn't in ``records`` gives no
    value. Other columns are ignored.
    """
    groups, claims = judged_values(records, history)
    judged = claims.filter("p >= 0.5")
    rank = F.struct(F.coalesce("at", F.lit(0).cast("timestamp")), (-F.col("resource_id")).alias("id"))
    last = lambda field: -F.max(F.when(F.col("field") == field, rank))["id"]
    kept = lambda field: F.collect_set(F.when(F.col("field") == field, F.col("value")))
    best = judged.groupBy("component").agg(last("publisher").alias("publisher_id"), last("volume").alias("volume_id"), kept("publisher").alias("publishers"), kept("volume").alias("volumes"))
    every = groups.select(F.col("component").alias("component")).distinct()
    return every.join(best, "component", "left").withColumnRenamed("component", "group_id")


def p2_found(records: DataFrame, history: DataFrame) -> DataFrame:
    """Each merged set with the members that its survivor takes publisher and volume from."""
    return survivors(records, history).select("group_id", "publisher_id", "volume_id")


def retained_values(records: DataFrame, history: DataFrame) -> DataFrame:
    """``group_id, field, value, n_records``: every value of a merged set that is judged true, and its holders."""
    _, claims = judged_values(records, history)
    return claims.filter("p >= 0.5").groupBy(F.col("component").alias("group_id"), "field", "value").agg(F.countDistinct("resource_id").alias("n_records"))
