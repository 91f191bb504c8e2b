"""Mixed timestamp formats and zones: all interpretations of a value, then the cheapest path through a source.

Plan: one Arrow pass reads every value into an array of valid interpretations. The values of one source and field form
a chain in record order. A chain is cut into blocks of record ids, so that a source that holds a third of all rows is
spread over many tasks. Each block runs Viterbi once for every pair of (interpretation of its first value,
interpretation of its last value); a block thereby shrinks to a matrix of at most 3 x 3 costs. The few matrices of a
chain are combined in order, which fixes every block's ends exactly, and the block's path for these ends is taken. The
result equals one Viterbi run over the whole chain. A reading against the stated conventions is taken where the values
around it, which can only be read so, say so; of the two instants of a repeated hour the one that keeps the order in time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scriptorium.functions.timestamps import labelled, readings
from scriptorium.plans.lineage import reliable

SWITCH, BACKWARD = 1.0, 1.0
BLOCK_IDS = 8192

_READ = pa.schema([
    ("chain", pa.string()), ("block", pa.int64()), ("field_name", pa.string()), ("row_id", pa.int64()), ("value_pos", pa.int32()),
    ("written", pa.string()), ("normal", pa.list_(pa.string())), ("form", pa.list_(pa.string())), ("cost", pa.list_(pa.float64())), ("at", pa.list_(pa.float64())),
])
_READ_DDL = "chain string, block bigint, field_name string, row_id bigint, value_pos int, written string, normal array<string>, form array<string>, cost array<double>, at array<double>"
_PATHS = pa.schema([
    ("chain", pa.string()), ("block", pa.int64()), ("field_name", pa.string()), ("row_id", pa.int64()), ("value_pos", pa.int32()),
    ("written", pa.string()), ("paths", pa.list_(pa.string())), ("n_last", pa.int32()), ("ends", pa.list_(pa.string())), ("costs", pa.list_(pa.float64())),
    ("forms", pa.list_(pa.string())), ("ats", pa.list_(pa.float64())),
])
_PATHS_DDL = "chain string, block bigint, field_name string, row_id bigint, value_pos int, written string, paths array<string>, n_last int, ends array<string>, costs array<double>, forms array<string>, ats array<double>"
_PICK = pa.schema([("chain", pa.string()), ("block", pa.int64()), ("pick", pa.int32())])


def _step(form_a: str, at_a: float, form_b: str, at_b: float) -> float:
    """What it costs that b follows a."""
    return (SWITCH if form_a != form_b else 0.0) + (BACKWARD if at_b < at_a else 0.0)


def viterbi(forms: list[list[str]], costs: list[list[float]], ats: list[list[float]], first: int) -> tuple[list[float], list[list[int]]]:
    """Cheapest cost of ending in each interpretation of the last value, given that of the first; and the way back."""
    best = [c if i == first else float("inf") for i, c in enumerate(costs[0])]
    back: list[list[int]] = [[0] * len(best)]
    for k in range(1, len(forms)):
        row, come = [], []
        for f, c, t in zip(forms[k], costs[k], ats[k]):
            options = [b + _step(pf, pt, f, t) for b, pf, pt in zip(best, forms[k - 1], ats[k - 1])]
            come.append(i := options.index(min(options)))
            row.append(options[i] + c)
        best, _ = row, back.append(come)
    return best, back


def _block_paths(group: pa.Table) -> pa.Table:
    group = group.sort_by([("row_id", "ascending"), ("value_pos", "ascending")])
    col = {n: group.column(n).to_pylist() for n in group.column_names}
    n, forms, costs, ats = group.num_rows, col["form"], col["cost"], col["at"]
    heads, tails = range(len(forms[0])), range(len(forms[-1]))
    paths: list[list[int]] = []
    matrix: list[float] = []
    for first in heads:
        best, back = viterbi(forms, costs, ats, first)
        for last in tails:
            matrix.append(best[last])
            way, i = [0] * n, last
            for k in range(n - 1, -1, -1):
                way[k] = i
                i = back[k][i]
            paths.append(way)
    lead = [True] + [False] * (n - 1)
    return pa.table({
        **{c: col[c] for c in ("chain", "block", "field_name", "row_id", "value_pos", "written")},
        "paths": [[col["normal"][k][p[k]] for p in paths] if len(paths) > 1 else [col["normal"][k][paths[0][k]]] for k in range(n)],
        "n_last": [len(tails)] * n,
        "ends": [[col["normal"][0][0]] if x else None for x in lead],
        "costs": [matrix if x else None for x in lead],
        "forms": [[*forms[0], *forms[-1]] if x else None for x in lead],
        "ats": [[*ats[0], *ats[-1]] if x else None for x in lead],
    }, schema=_PATHS)


def _stitch(group: pa.Table) -> pa.Table:
    """Which (first, last) pair each block of one chain takes."""
    group = group.sort_by("block")
    rows = group.to_pylist()
    trail: list[list[tuple[float, int]]] = []  # per block and pair: cheapest cost so far, pair of the block before
    for k, r in enumerate(rows):
        tails = r["n_last"]
        heads = len(r["costs"]) // tails
        here = []
        for pair, cost in enumerate(r["costs"]):
            before, come = 0.0, -1
            if k:
                p = rows[k - 1]
                ptails, pheads = p["n_last"], len(p["costs"]) // p["n_last"]
                options = [
                    c + _step(p["forms"][pheads + i % ptails], p["ats"][pheads + i % ptails], r["forms"][pair // tails], r["ats"][pair // tails])
                    for i, (c, _) in enumerate(trail[-1])
                ]
                come = options.index(min(options))
                before = options[come]
            here.append((before + cost, come))
        assert heads * tails == len(here)
        trail.append(here)
    picks, pair = [0] * len(rows), min(range(len(trail[-1])), key=lambda i: trail[-1][i][0])
    for k in range(len(rows) - 1, -1, -1):
        picks[k] = pair
        pair = trail[k][pair][1]
    return pa.table({"chain": group.column("chain"), "block": group.column("block"), "pick": pa.array(picks, pa.int32())}, schema=_PICK)


def normalise_timestamps(records: DataFrame, *, row_id: str = "resource_id", source: str = "utb_source",
                         plain: tuple[str, ...] = ("dc_date_issued",), labelled_fields: tuple[str, ...] = ("utb_fulltext_dates",)) -> DataFrame:
    """One row per readable date: ``field_name, row_id, value_pos, written, normal_form``.

    ``plain`` fields are arrays of dates, ``labelled_fields`` arrays of texts with labelled dates, counted through the
    whole field. Interpretations are chosen by Viterbi over each source's record order (see the module).
    Null, empty and unreadable dates are counted in ``value_pos`` and give no row; a null source is a source of its own;
    repeated rows give repeated results; an empty table gives an empty one. Other columns are ignored.
    Where paths tie, the earlier-listed (cheapest, then earliest) interpretation is taken.
    """
    fields = [(f, False) for f in plain] + [(f, True) for f in labelled_fields]
    src = F.col(f"`{source}`")
    src = F.array_join(src, "+") if dict(records.dtypes)[source].startswith("array") else src.cast("string")
    cols = [F.col(f"`{row_id}`").cast("bigint").alias("row_id"), F.coalesce(src, F.lit("")).alias("chain")]
    cols += [F.col(f"`{f}`").alias(f"field_{k}") for k, (f, _) in enumerate(fields)]
    present = [F.size(F.coalesce(F.col(f"field_{k}"), F.array().cast("array<string>"))) > 0 for k in range(len(fields))]
    keep = present[0]
    for p in present[1:]:
        keep = keep | p

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {n: [] for n in _READ.names}
            ids, chains = b.column(0).to_pylist(), b.column(1).to_pylist()
            for k, (name, is_labelled) in enumerate(fields):
                for rid, chain, value in zip(ids, chains, b.column(2 + k).to_pylist()):
                    if not value or rid is None:
                        continue
                    for pos, written in labelled(value) if is_labelled else enumerate((x.strip() if x else "" for x in value), 1):
                        if not (found := readings(written)):
                            continue
                        row = (f"{name}|{chain}", rid // BLOCK_IDS, name, rid, pos, written, [r.normal for r in found], [r.form for r in found], [r.cost for r in found], [r.at for r in found])
                        for n, v in zip(_READ.names, row):
                            out[n].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=_READ)

    read_values = records.select(*cols).filter(keep).mapInArrow(read, _READ_DDL)
    blocks = reliable(read_values.groupBy("chain", "block").applyInArrow(_block_paths, _PATHS_DDL))
    ends = blocks.filter(F.col("costs").isNotNull()).select("chain", "block", "n_last", "costs", "forms", "ats")
    picks = ends.groupBy("chain").applyInArrow(_stitch, "chain string, block bigint, pick int")
    one = blocks.filter(F.size("paths") == 1).select("field_name", "row_id", "value_pos", "written", F.element_at("paths", 1).alias("normal_form"))
    several = blocks.filter(F.size("paths") > 1).join(picks, ["chain", "block"])
    return one.unionByName(several.select("field_name", "row_id", "value_pos", "written", F.element_at("paths", F.col("pick") + 1).alias("normal_form")))


def p6_found(records: DataFrame) -> DataFrame:
    """Dates not already written in their normal form."""
    return (
        normalise_timestamps(records)
        .filter(F.col("normal_form") != F.col("written"))
        .select(F.col("row_id").alias("resource_id"), "field_name", "value_pos", "normal_form")
        .distinct()
    )
