"""Mixing sources to target weights along a time-varying curriculum.

Plan: one Arrow pass measures the texts. Each source's weight is a schedule over training time whose integral is its
target share; integrating it gives the source's cumulative token demand, and inverting that gives every copy of a
document the time at which its source has asked for its tokens. Cumulative sizes within a source come from hash buckets
(sums by bucket, offsets over buckets, a running sum within a bucket), so a source of any size is spread over
``BUCKETS`` tasks. Copies are range-sorted by time. Nothing is collected but one line for each source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from scriptorium.llm.tokens import DEFAULT_VOCABULARY, token_sizes
from scriptorium.plans.lineage import reliable

BUCKETS = 1024
#: How far the weights move over time: 0 keeps them constant, 1 as far as no weight falls below 0.
TILT = 0.5
#: Most targets; a longer list is refused. Sources without a target may be as many as they are.
MAX_SOURCES = 100_000


def schedule(shares: dict[str, float], natural: dict[str, float], tilt: float = TILT) -> dict[str, tuple[float, float]]:
    """Weight of each source at the beginning and the end, linear between; the mean is its share, at any time they sum to 1.

    The mixture starts nearer to the natural shares of the sources and ends as far on the other side of the targets.
    """
    move = {s: shares[s] - natural.get(s, 0.0) for s in shares}
    off = sum(move.values()) / max(1, len(move))
    move = {s: m - off for s, m in move.items()}
    room = min([shares[s] / abs(m) for s, m in move.items() if abs(m) > 1e-12], default=0.0)
    scale = tilt * min(1.0, room)
    return {s: (shares[s] - scale * move[s], shares[s] + scale * move[s]) for s in shares}


def reachable_total(sizes: dict[str, int], targets: dict[str, tuple[float, int]]) -> float:
    """Most tokens of which every source can give its target share, each document repeated at most so often."""
    return min((sizes[s] * cap / share for s, (share, cap) in targets.items() if share > 0), default=0.0)


def _time_of(tokens: Column, first: Column, last: Column, total: Column) -> Column:
    """Inverse of the cumulative demand total * (first t + (last - first) t^2 / 2)."""
    need = tokens / total
    root = F.sqrt(F.greatest(first * first + 2 * (last - first) * need, F.lit(0.0)))
    return F.least(F.lit(1.0), 2 * need / (first + root))


def mix(documents: DataFrame, targets: DataFrame, *, total_tokens: int | None = None, tilt: float = TILT, doc_id: str = "doc_id", text: str = "text", source: str = "source", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``position, doc_id, source, repeat_no, n_tokens`` of the mixture, range-sorted by position.

    ``targets``: ``source, target_share, max_repeats``. ``position`` is the token of the whole mixture at which the copy's
    middle is due. A copy is used while its middle lies within its source's demand, so a source's share differs from its
    target by at most half a document. ``total_tokens`` defaults to the most of which all targets can be met; a larger
    total is lowered to it. Each round over a source takes its documents in the same order, by a hash of the id.
    Sources without a target, and null sources, aren't used. A target with a null or non-positive share or cap, or whose
    source has no tokens, is left out and the other shares are taken in proportion; texts without tokens aren't used;
    repeated rows are documents of their own; without targets or documents the result is empty. Other columns are ignored.
    More than ``MAX_SOURCES`` targets are an error.
    """
    spark = documents.sparkSession
    sizes = token_sizes(documents.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{source}`").alias("source"), F.col(f"`{text}`").alias("text")), keys=("doc_id", "source"), vocabulary=vocabulary)
    sizes = reliable(sizes.filter("source is not null and n_tokens > 0").withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int")))
    sums = sizes.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("tokens"))
    listed = targets.select("source", "target_share", "max_repeats").filter("source is not null").limit(MAX_SOURCES + 1).collect()
    if len(listed) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} targets")
    named = F.broadcast(targets.select("source").distinct())  # at most MAX_SOURCES, as just counted
    have = {r["source"]: r["tokens"] for r in sums.join(named, "source", "left_semi").groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}
    wanted = {r["source"]: (r["target_share"], r["max_repeats"]) for r in listed if r["source"] in have and (r["target_share"] or 0) > 0 and (r["max_repeats"] or 0) > 0}
    whole = sum(share for share, _ in wanted.values())
    wanted = {s: (share / whole, cap) for s, (share, cap) in wanted.items()}
    total = reachable_total({s: have[s] for s in wanted}, wanted)
    total = min(total, total_tokens) if total_tokens is not None else total
    natural = {s: have[s] / max(1, sum(have[x] for x in wanted)) for s in wanted}
    weights = schedule({s: share for s, (share, _) in wanted.items()}, natural, tilt)
    plan = [(s, have[s], share * total, math.ceil(share * total / have[s] - 1e-12), *weights[s], float(total)) for s, (share, _) in sorted(wanted.items())]
    plan_df = F.broadcast(spark.createDataFrame(plan, "source string, size bigint, demand double, rounds int, first double, last double, total double"))

    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "bucket", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("offset"))
    running = Window.partitionBy("source", "bucket").orderBy(F.xxhash64("doc_id"), "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.withColumn("within", F.coalesce(F.sum("n_tokens").over(running), F.lit(0))).join(offsets, ["source", "bucket"]).join(plan_df, "source")
    middle = F.col("offset") + F.col("within") + F.col("n_tokens") / 2
    copies = placed.select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.col("rounds") - 1, F.lit(0)))).alias("round"))
    due = copies.withColumn("due", F.col("round").cast("double") * F.col("size") + middle).filter(F.col("due") < F.col("demand"))
    time = _time_of(F.col("due"), F.col("first"), F.col("last"), F.col("total"))
    out = due.select(F.floor(time * F.col("total")).cast("bigint").alias("position"), "doc_id", "source", (F.col("round") + 1).cast("int").alias("repeat_no"), "n_tokens")
    return out.orderBy("position", "source", "doc_id", "repeat_no")


def share_report(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, target_share, tokens, actual_share, repeats_used, max_repeats``: the shares reached, a line for each target."""
    by = mixture.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.max("repeat_no").alias("repeats_used"))
    by = by.withColumn("all_tokens", F.sum("tokens").over(Window.partitionBy()))  # a row for each source
    out = targets.select("source", "target_share", "max_repeats").join(by, "source", "left")
    tokens = F.coalesce("tokens", F.lit(0))
    return out.select("source", "target_share", tokens.alias("tokens"), F.coalesce(F.round(tokens / F.col("all_tokens"), 6), F.lit(0.0)).alias("actual_share"), F.coalesce("repeats_used", F.lit(0)).alias("repeats_used"), "max_repeats")
