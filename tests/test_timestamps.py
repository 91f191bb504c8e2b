"""Mixed timestamp formats and zones."""

from __future__ import annotations

import itertools
import random

import pyarrow as pa
import pytest

from scriptorium.functions.timestamps import labelled, readings
from scriptorium.operators import timestamps as T


@pytest.mark.parametrize(
    ("text", "normal"),
    [
        ("2005-12-09", "2005-12-09"), ("1998", "1998"), ("1998-01", "1998-01"), ("16 February 2002", "2002-02-16"), ("10. 1. 2013", "2013-01-10"), ("12.05.2006", "2006-05-12"),
        ("01/03/2006", "2006-01-03"), ("13/02/2010", "2010-02-13"), ("1998/02/07", "1998-02-07"), ("19980118", "1998-01-18"), ("01-FEB-22", "2022-02-01"), ("10-Aug-2009", "2009-08-10"),
        ("10th of December 2016", "2016-12-10"), ("Apr. 3, 2009", "2009-04-03"), ("April 2018", "2018-04"), ("11. října 2008", "2008-10-11"), ("1007032508557", "2001-11-29T11:15:08Z"),
        ("1005422954", "2001-11-10T20:09:14Z"), ("14.3.2004 23:51", "2004-03-14T22:51:00Z"), ("1.7.2004 12:00", "2004-07-01T10:00:00Z"), ("2006-10-01T23:57:43+0200", "2006-10-01T21:57:43Z"),
        ("1998-07-08T15:09:20.301100+02:00", "1998-07-08T13:09:20Z"), ("10 Mar 2010 21:48 JST", "2010-03-10T12:48:00Z"), ("Sat, 01 May 2004 02:26:51 +0200", "2004-05-01T00:26:51Z"),
        ("2010-10-31 02:30:00", "2010-10-31T00:30:00Z"), ("29-FEB-20", "2020-02-29"),
    ],
)
def test_reading(text, normal):
    assert readings(text)[0].normal == normal


@pytest.mark.parametrize("text", ["", None, "n.d.", "in press", "0000-00-00", "20xx", "00th March 20xx", "XX June", "30.13.2002", "x" * 500, " " * 500, "1. 2. " * 200])
def test_unreadable(text):
    assert readings(text) == []


def test_all_interpretations_are_kept():
    assert [r.normal for r in readings("5.4.2001")] == ["2001-04-05", "2001-05-04"]
    assert {r.normal for r in readings("2010-10-31 02:30:00")} == {"2010-10-31T00:30:00Z", "2010-10-31T01:30:00Z"}


def test_long_dates_are_read_whole():
    assert readings("12." + " " * 200 + "5. 2006")[0].normal == "2006-05-12"
    assert readings("2006-05-12T10:00:00." + "0" * 300 + "Z")[0].normal == "2006-05-12T10:00:00Z"


def test_viterbi_decides_where_the_convention_leaves_readings_open(records):
    """Values around an open one settle it; the cheapest reading of each value alone says otherwise."""
    dates = ["01.25.2005", "02.03.2005", "03.28.2005", "05.04.2006"]
    dates += ["31.10.2010 02:20", "2010-10-31T01:10:00Z", "31.10.2010 02:30", "2010-10-31T03:10:00Z"]
    df = records(*[{"resource_id": i, "dc_date_issued": d} for i, d in enumerate(dates, 1)])
    got = {r.row_id: r.normal_form for r in T.normalise_timestamps(df).collect()}
    alone = {i: readings(d)[0].normal for i, d in enumerate(dates, 1)}
    assert (alone[2], alone[7]) == ("2005-03-02", "2010-10-31T00:30:00Z")
    assert (got[2], got[7]) == ("2005-02-03", "2010-10-31T01:30:00Z")  # between month-first dates; after 01:10
    assert (got[4], got[5]) == ("2006-04-05", "2010-10-31T00:20:00Z")  # beside one of them only; nothing before it


def test_labels_count_through_the_field():
    got = labelled(["{Received: 2010-01-02; Accepted: n.d. / First published 2 May 2010}", None, "", "Zveřejněno 3. 6. 2010"])
    assert got == [(1, "2010-01-02"), (2, "n.d."), (3, "2 May 2010"), (4, "3. 6. 2010")]


def test_query_and_edge_cases(records, spark):
    df = records(
        {"resource_id": 1, "dc_date_issued": "16 February 2002", "utb_fulltext_dates": ["Received: 20xx", "Accepted 1.2.2003"], "utb_source": "j-wok"},
        {"resource_id": 2, "dc_date_issued": "2003-01-01"}, {"resource_id": 3}, {"resource_id": 4, "dc_date_issued": [None], "utb_fulltext_dates": []},
        {"resource_id": 2, "dc_date_issued": "2003-01-01"}, {"resource_id": None, "dc_date_issued": "1 May 2003"},
    )
    got = {tuple(r) for r in T.p6_found(df.withColumnRenamed("author_flags", "block")).collect()}
    assert got == {(1, "dc_date_issued", 1, "2002-02-16"), (1, "utb_fulltext_dates", 2, "2003-02-01")}
    assert T.p6_found(df.limit(0)).count() == 0


def _table(values):
    """Values as a chain with blocks of three ids."""
    rows = [{"chain": "c", "block": i // 3, "field_name": "f", "row_id": i, "value_pos": 1, "written": "w", "normal": [o[0] for o in v], "form": [o[1] for o in v], "cost": [o[2] for o in v], "at": [o[3] for o in v]} for i, v in enumerate(values)]
    return rows


@pytest.mark.parametrize("seed", range(6))
def test_blocks_give_the_same_path_cost_as_one_chain(seed):
    rng = random.Random(seed)
    values = [[(f"{i}-{k}", rng.choice("ab"), rng.random(), rng.random() * 9) for k in range(rng.choice((1, 2, 2)))] for i in range(8)]

    def cost(path):
        picked = [v[k] for v, k in zip(values, path)]
        return sum(p[2] for p in picked) + sum(T._step(x[1], x[3], y[1], y[3]) for x, y in zip(picked, picked[1:]))

    best = min(cost(p) for p in itertools.product(*[range(len(v)) for v in values]))
    rows = _table(values)
    blocks = [T._block_paths(pa.Table.from_pylist([r for r in rows if r["block"] == b], schema=T._READ)) for b in range(3)]
    ends = pa.concat_tables([b.slice(0, 1).select(["chain", "block", "n_last", "costs", "forms", "ats"]) for b in blocks])
    picks = dict(zip(*(T._stitch(ends).column(c).to_pylist() for c in ("block", "pick"))))
    chosen = [p[picks[b] if len(p) > 1 else 0] for b, t in enumerate(blocks) for p in t.column("paths").to_pylist()]
    assert cost([int(c.split("-")[1]) for c in chosen]) == pytest.approx(best)
