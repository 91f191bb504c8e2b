"""Filling fixed-capacity containers: a configuration linear program over the length histogram, rounded.

Plan: one Arrow pass measures the texts; a text larger than the container is split, nothing else. What is left is decided
on the histogram of lengths, at most ``GRID`` numbers for each capacity whatever the input: multiplicative weights with
knapsack pricing yield container patterns, these are rounded down, and what remains is priced again until nothing is
left, all by pattern and count. Pieces then take their places by rank within their length; ranks come from salted counts, so that
no length, however common, is numbered in one task.
"""

from __future__ import annotations

import bisect
import heapq
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from scriptorium.llm.tokens import DEFAULT_VOCABULARY, token_sizes
from scriptorium.plans.lineage import reliable

#: Lengths are told apart on a grid of this many steps up to the capacity, and rounded up to it.
GRID = 2048
#: Rounds of the program at most; it ends sooner once this share of the tokens is covered.
ROUNDS, COVERED, STEP, RATE = 1200, 0.75, 1.0, 0.05
#: The longest lengths left and those with the most tokens are priced, so many of each: by the program, on what it leaves.
PRICED, PRICED_REST = 128, 512
#: Worth of a length on what rounding leaves is this power of it: long items, which fit fewest places, go first.
POWER = 1.1
TRY_EVERY = 50
SALTS = 64


#: Most capacities; a longer list is refused.
MAX_CAPACITIES = 10_000


class Use(NamedTuple):
    """A pattern (length class to number of items), how many containers are filled by it, and the step it comes from.

    Steps: ``program`` (rounded configuration program), ``priced`` (pricing of what is left), ``first_fit``.
    """

    pattern: dict[int, int]
    times: int
    step: str = "first_fit"


def price(values: dict[int, float], counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Most valuable pattern that fits: bounded knapsack by dynamic programming, counts divided into powers of two."""
    best = np.zeros(capacity + 1)
    taken: list[tuple[int, int, np.ndarray]] = []
    for length, value in values.items():
        left, k = min(counts[length], capacity // length), 1
        while left > 0:
            k = min(k, left)
            weight = k * length
            with_it = best[: capacity + 1 - weight] + k * value
            better = with_it > best[weight:]
            if better.any():
                np.copyto(best[weight:], with_it, where=better)
                taken.append((length, k, better))
            left -= k
            k *= 2
    out: dict[int, int] = {}
    room = capacity
    for length, k, flags in reversed(taken):
        if room >= k * length and flags[room - k * length]:
            out[length] = out.get(length, 0) + k
            room -= k * length
    return out


def worth_pricing(left: dict[int, float], most: int) -> list[int]:
    """The ``most`` longest lengths and the ``most`` with the most tokens left: enough to fill any container."""
    if len(left) <= 2 * most:
        return list(left)
    return list(dict.fromkeys([*heapq.nlargest(most, left), *heapq.nlargest(most, left, key=lambda l: (l * left[l], l))]))


def fractional(counts: dict[int, int], capacity: int, rounds: int = ROUNDS) -> list[tuple[dict[int, int], float]]:
    """Patterns and amounts of the configuration program, by multiplicative weights.

    The weight of a length is its share of the container, less the more of its items are covered; each round prices the
    pattern of greatest weight and takes as much of it as covers at most ``STEP`` of what is left of any of its lengths.
    """
    covered = dict.fromkeys(counts, 0.0)
    found: dict[tuple, float] = {}
    enough = COVERED * sum(l * n for l, n in counts.items())
    done = 0.0
    for _ in range(rounds if counts else 0):
        left = {l: n - covered[l] for l, n in counts.items() if n - covered[l] >= 1}
        if not left or done >= enough:
            break
        values = {l: l * math.exp(-RATE * covered[l] / counts[l]) for l in worth_pricing(left, PRICED)}
        pattern = price(values, {l: math.ceil(left[l]) for l in values}, capacity)
        if not pattern:
            break
        amount = float(max(1, math.floor(STEP * min(left[l] / a for l, a in pattern.items()))))
        done += amount * sum(l * a for l, a in pattern.items())
        for l, a in pattern.items():
            covered[l] += a * amount
        key = tuple(sorted(pattern.items()))
        found[key] = found.get(key, 0.0) + amount
    return [(dict(k), x) for k, x in found.items()]


def fill_rest(counts: dict[int, int], capacity: int) -> list[Use]:
    """First-fit decreasing on counts: the largest length left, then the largest that still fits, as often as it can be repeated."""
    left = {l: n for l, n in counts.items() if n > 0}
    order = sorted(left)
    out: list[Use] = []
    while order:
        pattern: dict[int, int] = {}
        room, at = capacity, len(order) - 1
        while at >= 0:
            length = order[at]
            take = min(left[length], room // length)
            if take:
                pattern[length] = take
                room -= take * length
            at = min(at - 1, bisect.bisect_right(order, room) - 1)
        times = min(left[l] // a for l, a in pattern.items())
        out.append(Use(pattern, times))
        for l, a in pattern.items():
            left[l] -= a * times
            if not left[l]:
                order.pop(bisect.bisect_left(order, l))
    return out


def price_rest(counts: dict[int, int], capacity: int) -> list[Use]:
    """Patterns of the same pricing on what is left, each as often as its items last; every pattern uses up a length.

    Now and then the rest is filled first-fit decreasing, which ends it where that gives the least number possible.
    """
    left = {l: n for l, n in counts.items() if n > 0}
    least = -(-sum(l * n for l, n in left.items()) // capacity)
    out: list[Use] = []
    while left:
        if len(out) % TRY_EVERY == 0:
            rest = fill_rest(left, capacity)
            if sum(u.times for u in out + rest) == least:
                return out + rest
        pattern = price({l: float(l) ** POWER for l in worth_pricing(left, PRICED_REST)}, left, capacity)
        times = min(left[l] // a for l, a in pattern.items())
        out.append(Use(pattern, times, "priced"))
        for l, a in pattern.items():
            left[l] -= a * times
            if not left[l]:
                del left[l]
    return out


def solve(counts: dict[int, int], capacity: int) -> list[Use]:
    """Patterns that hold every item of the histogram exactly once.

    Of the program's patterns the fullest are used, their amounts rounded down; what they leave, with the items of the
    others, is priced again. Only should plain first-fit decreasing need fewer containers (not as many), it is taken.
    """
    left = dict(counts)
    uses: list[Use] = []
    fill = lambda p: sum(l * a for l, a in p.items())
    found = fractional(counts, capacity)
    fullest = max((fill(p) for p, _ in found), default=0)
    for pattern, amount in sorted((px for px in found if fill(px[0]) == fullest), key=lambda px: (-px[1], sorted(px[0].items()))):
        times = min(math.floor(amount + 1e-9), *(left[l] // a for l, a in pattern.items()))
        if times > 0:
            uses.append(Use(pattern, times, "program"))
            for l, a in pattern.items():
                left[l] -= a * times
    uses += price_rest(left, capacity)
    return min(uses, fill_rest(counts, capacity), key=lambda u: sum(x.times for x in u))


STEPS = ("program", "priced", "first_fit")


def _places(uses: list[Use]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first rank, first container, items in one container and step (number) of its runs of places."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    filled: dict[int, int] = {}
    container = 0
    for pattern, times, step in uses:
        for l, a in pattern.items():
            runs.setdefault(l, []).append((filled.get(l, 0), container, a, STEPS.index(step)))
            filled[l] = filled.get(l, 0) + a * times
        container += times
    return {l: tuple(np.array(x, dtype=np.int64) for x in zip(*r)) for l, r in runs.items()}


def _ranked(pieces: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``pieces`` with ``rank`` (from 0) within ``keys``, and no group in one task: ranks within salts, offset by counts."""
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64(*order), F.lit(SALTS)).cast("int"))
    counts = salted.groupBy(*keys, "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*keys).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy(*keys, "salt").orderBy(*order)
    numbered = salted.withColumn("rank", F.row_number().over(within) - 1)
    return numbered.join(offsets, [*keys, "salt"]).withColumn("rank", F.col("rank") + F.col("offset")).drop("salt", "offset")


def pieces_of(documents: DataFrame, capacities: DataFrame, *, doc_id: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``capacity_id, capacity_tokens, doc_id, piece_no, start_token, n_tokens, class``: texts, split only where larger than the capacity."""
    sizes = token_sizes(documents.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text")), vocabulary=vocabulary)
    rows = capacities.select("capacity_id", "capacity_tokens").distinct().limit(MAX_CAPACITIES + 1).collect()
    if len(rows) > MAX_CAPACITIES:
        raise ValueError(f"more than {MAX_CAPACITIES} capacities")
    caps = [(r["capacity_id"], r["capacity_tokens"]) for r in rows if r["capacity_tokens"] and r["capacity_tokens"] > 0]
    listed = F.array(*[F.struct(F.lit(i).cast("int").alias("capacity_id"), F.lit(c).cast("bigint").alias("capacity_tokens")) for i, c in sorted(caps)])
    if not caps:
        listed = listed.cast("array<struct<capacity_id:int,capacity_tokens:bigint>>")
    each = sizes.select("doc_id", F.col("n_tokens").alias("size"), F.inline(listed))
    last = F.greatest(F.ceil(F.col("size") / F.col("capacity_tokens")), F.lit(1)) - 1
    cut = each.select("capacity_id", "capacity_tokens", "doc_id", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece_no"))
    start = F.col("piece_no") * F.col("capacity_tokens")
    cut = cut.select("capacity_id", "capacity_tokens", "doc_id", F.col("piece_no").cast("int").alias("piece_no"), start.alias("start_token"), F.least("capacity_tokens", F.col("size") - start).alias("n_tokens"))
    unit = F.greatest(F.lit(1), F.ceil(F.col("capacity_tokens") / GRID))
    return cut.withColumn("class", F.ceil(F.col("n_tokens") / unit).cast("int"))


def pack(documents: DataFrame, capacities: DataFrame, *, doc_id: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``capacity_id, container_id, doc_id, piece_no, start_token, n_tokens, step``: every text in containers of every capacity.

    Containers of one capacity are numbered from 0. No container holds more than its capacity; a text within the capacity
    is never split, a larger one into full pieces and a rest. Texts without tokens (null and empty ones) go into
    container 0. Repeated rows are items of their own; ties go by id and piece; an empty table of either kind gives an
    empty result. A capacity that is null or not above 0 is left out; more than ``MAX_CAPACITIES`` are an error. ``step``
    tells which step filled the container (``program``, ``priced``, ``first_fit``). Other columns are ignored.
    """
    pieces = reliable(pieces_of(documents, capacities, doc_id=doc_id, text=text, vocabulary=vocabulary))
    histogram: dict[int, dict[int, int]] = {}
    limits: dict[int, int] = {}
    for r in pieces.groupBy("capacity_id", "capacity_tokens", "class").agg(F.count("*").alias("n")).collect():  # at most GRID + 1 for a capacity
        limits[r["capacity_id"]] = r["capacity_tokens"]
        if r["class"] > 0:
            histogram.setdefault(r["capacity_id"], {})[r["class"]] = r["n"]
    places = {}
    for cap, counts in histogram.items():
        unit = max(1, math.ceil(limits[cap] / GRID))
        places[cap] = _places(solve(counts, limits[cap] // unit))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            caps, classes, ranks = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("capacity_id", "class", "rank"))
            out, steps = np.zeros(len(caps), dtype=np.int64), np.zeros(len(caps), dtype=np.int64)
            for cap in np.unique(caps):
                for cls in np.unique(classes[caps == cap]):
                    if cls > 0:
                        at = (caps == cap) & (classes == cls)
                        first, container, items, step = places[int(cap)][int(cls)]
                        run = np.searchsorted(first, ranks[at], side="right") - 1
                        out[at] = container[run] + (ranks[at] - first[run]) // items[run]
                        steps[at] = step[run]
            keep = ["capacity_id", "doc_id", "piece_no", "start_token", "n_tokens"]
            columns = [b.column(b.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([columns[0], pa.array(out), *columns[1:], pa.array([STEPS[k] for k in steps.tolist()], pa.string())], names=["capacity_id", "container_id", *keep[1:], "step"])

    real = pieces.filter("class > 0")
    ranked = _ranked(real, ["capacity_id", "class"], ["doc_id", "piece_no"])
    ddl = "capacity_id int, container_id bigint, doc_id bigint, piece_no int, start_token bigint, n_tokens bigint, step string"
    nothing = pieces.filter("class = 0").select("capacity_id", F.lit(0).cast("bigint").alias("container_id"), "doc_id", "piece_no", "start_token", "n_tokens", F.lit("first_fit").alias("step"))
    return ranked.mapInArrow(assign, ddl).unionByName(nothing)


def fill_report(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """``capacity_id, n_containers, by_program, by_pricing, by_first_fit, least_containers, fill`` of each capacity.

    Containers used, how many of them each step filled, the least that the tokens need, the share filled.
    """
    boxes = packed.groupBy("capacity_id", "container_id").agg(F.max("step").alias("step"), F.sum("n_tokens").alias("tokens"))
    made = lambda step, name: F.count_if(F.col("step") == step).alias(name)
    by = boxes.groupBy("capacity_id").agg(F.count("*").alias("n_containers"), made("program", "by_program"), made("priced", "by_pricing"), made("first_fit", "by_first_fit"), F.sum("tokens").alias("tokens"))
    by = by.join(capacities.select("capacity_id", "capacity_tokens").distinct(), "capacity_id")
    fill = F.round(F.col("tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6).alias("fill")
    return by.select("capacity_id", "n_containers", "by_program", "by_pricing", "by_first_fit", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_containers"), fill)
