"""Best representative of each duplicate group."""

from __future__ import annotations

import random
from datetime import datetime

import pytest

from scriptorium.llm import survivors as S


def history(spark, *pairs):
    rows = [(r, a, b, datetime(2025, 1, 1)) for a, b in pairs for r in (a, b)]
    return spark.createDataFrame(rows, "resource_id bigint, dedup_kept_resource_id int, dedup_other_resource_id int, dedup_merged_at timestamp")


def test_components_against_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(200, i) for i in range(201, 260)] + [(None, 3), (7, 7)]
    parent: dict = {}

    def find(x):
        parent.setdefault(x, x)
        return x if parent[x] == x else find(parent[x])

    for a, b in edges:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in S.components(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect()}
    assert got == {x: find(x) for x in list(parent)}


def test_survivor(spark, records):
    full = "Borovice University Press"
    many = [{"resource_id": 1000 + i, "dc_publisher": full, "utb_source": "j-wok"} for i in range(20)]
    at = lambda y: f"{y}-01-01T00:00:00Z"
    df = records(
        *many, {"resource_id": 1, "dc_publisher": full, "utb_relation_volume": "12", "dc_date_accessioned": at(2010), "utb_source": "j-wok"},
        {"resource_id": 2, "dc_publisher": "Bor. Uni. Pre.", "utb_relation_volume": "in press", "dc_date_accessioned": at(2015), "utb_source": "j-scopus"},
        {"resource_id": 3, "dc_publisher": "Borovice Univ", "utb_relation_volume": "13", "dc_date_accessioned": at(2012), "utb_source": "j-riv"},
        {"resource_id": 4, "dc_publisher": "N/A", "utb_relation_volume": "0", "dc_date_accessioned": at(2019), "utb_source": "j-riv"}, {"resource_id": 5, "dc_publisher": None, "utb_relation_volume": None},
        {"resource_id": 6, "dc_publisher": full, "utb_relation_volume": "4", "dc_date_accessioned": at(2001)}, {"resource_id": 7, "dc_publisher": full, "utb_relation_volume": "4", "dc_date_accessioned": at(2001)},
    )
    log = history(spark, (1, 2), (2, 3), (1, 2), (4, 5), (6, 7))
    got = sorted(tuple(r) for r in S.p2_found(df, log).collect())
    assert got == [(1, 1, 3), (4, None, None), (6, 6, 6)]
    assert S.p2_found(df, log.limit(0)).count() == 0
    kept = {r.group_id: sorted(r.volumes) for r in S.survivors(df, log).filter("volumes is not null").collect()}
    assert kept[1] == ["12", "13"]


def test_expectation_maximisation_decides(spark, records, monkeypatch):
    """Without EM's figures nothing tells a stand-in or an abbreviation from a value; with them the result is another."""
    full = "Borovice University Press"
    df = records(*[{"resource_id": i, "dc_publisher": full, "utb_source": "j-wok", "utb_relation_volume": "7"} for i in range(1, 21)], {"resource_id": 30, "dc_publisher": "Bor. Uni. Pre.", "dc_date_accessioned": "2020-01-01T00:00:00Z", "utb_source": "j-riv", "utb_relation_volume": "in press"})
    log = history(spark, (1, 30), (2, 3))
    assert sorted(tuple(r) for r in S.p2_found(df, log).collect()) == [(1, 1, 1), (2, 2, 2)]
    values = sorted(tuple(r) for r in S.retained_values(df, log).collect())
    assert values == [(1, "publisher", full, 1), (1, "volume", "7", 1), (2, "publisher", full, 2), (2, "volume", "7", 2)]
    learn = S.infer_quality
    monkeypatch.setattr(S, "infer_quality", lambda patterns: (dict.fromkeys(learn(patterns)[0], (0.5, 0.5)), {"publisher": 0.7, "volume": 0.7}))
    assert sorted(tuple(r) for r in S.p2_found(df, log).collect()) == [(1, 30, 30), (2, 2, 2)]


def test_components_that_do_not_settle_are_an_error(spark):
    with pytest.raises(RuntimeError):
        S.components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a int, b int"), "a", "b", max_rounds=1)


def test_quality_is_inferred(spark):
    """A source that mostly says what the tests confirm comes out sensitive, one that says wrong things unspecific."""
    mk = lambda ok, good, bad: [("t", "reader", ok), ("good", "export", good), ("bad", "export", bad)]
    rows = [(1, "f", mk(True, True, False), 40.0), (2, "f", mk(False, False, True), 30.0), (3, "f", mk(True, True, True), 10.0)]
    patterns = spark.createDataFrame(rows, "pattern bigint, field string, obs array<struct<observer:string,kind:string,said:boolean>>, n double")
    quality, prior = S.infer_quality(patterns)
    assert quality["f", "good"][0] > 0.85 and quality["f", "good"][1] > 0.85 and quality["f", "bad"][1] < 0.3 and 0.5 < prior["f"] < 0.8
