"""Workplace tree: closure, climbing, fuzzy lookup of a node."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scriptorium.functions import text as X
from scriptorium.functions.similarity import jaro_winkler
from scriptorium.plans.lineage import reliable

MAX_DEPTH = 100
MAX_NODES = 20_000


def closure(nodes: DataFrame, *, node: str = "id", parent: str = "parent_id", max_depth: int = MAX_DEPTH) -> DataFrame:
    """``node, ancestor, depth`` of every node and every ancestor, itself at depth 0; a cycle is followed once.

    Doubles the known paths in each round, so a tree of depth d takes log2(d) joins. A tree deeper than ``max_depth`` is an
    error.
    """
    base = nodes.select(F.col(node).alias("node"), F.col(parent).alias("parent")).filter("node is not null").distinct()
    paths = base.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth"))
    step = base.filter("parent is not null and parent <> node").select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("depth"))
    known = base.select(F.col("node").alias("ancestor"))
    paths = paths.unionByName(step.join(known, "ancestor").select("node", "ancestor", "depth"))
    reach, before = 1, -1
    while reach < 4 * max_depth:  # one more round shows that nothing is left
        left, right = paths.alias("l"), paths.alias("r")
        longer = left.join(right, F.col("l.ancestor") == F.col("r.node")).select("l.node", "r.ancestor", (F.col("l.depth") + F.col("r.depth")).alias("depth"))
        paths = reliable(longer.groupBy("node", "ancestor").agg(F.min("depth").alias("depth")))
        reach *= 2
        now = paths.count()
        if now == before:
            break
        before = now
    else:
        raise ValueError(f"the tree is deeper than {max_depth}")
    return paths


def first_ancestor(paths: DataFrame, wanted: DataFrame, *, key: str = "id") -> DataFrame:
    """``node, ancestor``: the nearest ancestor (or itself) that is among ``wanted``."""
    hits = paths.join(wanted.select(F.col(key).alias("ancestor")).distinct(), "ancestor")
    return hits.groupBy("node").agg(F.min_by("ancestor", F.struct("depth", "ancestor")).alias("ancestor"))


def find_nodes(texts: DataFrame, nodes: DataFrame, threshold: float = 0.92) -> DataFrame:
    """``text, id, score``: for each distinct text the best node: equal 1, one name in the other at least 0.92, else Jaro-Winkler.

    ``nodes``: ``id, name``; of equal scores the longer name, then the smaller id. Every task holds the nodes, which are
    refused beyond ``MAX_NODES``; each text is compared once, however often it occurs. Blank texts are left out.
    """
    known = nodes.select(F.col("id").cast("bigint").alias("id"), X.workplace_form(F.col("name")).alias("b")).distinct().filter("b <> ''").limit(MAX_NODES + 1).collect()
    if len(known) > MAX_NODES:
        raise ValueError(f"more than {MAX_NODES} nodes")
    listed = [(r["b"], r["id"]) for r in known]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list[tuple[str, int, float]] = []
            for text, plain in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                best = max(((_node_score(plain, name), len(name), -i) for name, i in listed), default=(0.0, 0, 0))
                if best[0] >= threshold:
                    found.append((text, -best[2], best[0]))
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.float64())], names=["text", "id", "score"])

    rows = texts.select("text", X.workplace_form(F.col("text")).alias("a")).distinct().filter("a <> ''")
    return rows.mapInArrow(find, "text string, id bigint, score double").withColumn("score", F.round("score", 4))


def _node_score(a: str, b: str) -> float:
    if a == b:
        return 1.0
    inside = 0.92 if a in b or b in a else 0.0
    return max(inside, jaro_winkler(a, b))
