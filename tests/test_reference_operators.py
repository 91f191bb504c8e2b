"""Validation, dates, affiliations, authors, journals, duplicates, review, providers."""

from __future__ import annotations

import itertools
import json
import random
from datetime import date, datetime

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from scriptorium import schema
from scriptorium.functions import fulltext_dates as D, text as X
from scriptorium.functions.similarity import jaro_winkler
from scriptorium.operators import affiliations, authors, completion, crossref, dates, dedup, journals, review, tree, validate
from scriptorium.settings import Settings
from scriptorium.sources import providers, snapshots


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_validation(records, spark):
    df = records(
        {"resource_id": 1, "dc_title": "Fine", "dc_contributor_author": ["Novák, Jan"], "utb_contributor_internalauthor": ["Novak, Jan"]},
        {"resource_id": 2, "dc_title": "Title  ", "dc_identifier_doi": "https://doi.org/10.1234/x", "utb_identifier_wok": "A00123", "utb_wos_affiliation": "Univ|Town"},
        {"resource_id": 3, "dc_title": "Main [Vedľajší]", "utb_contributor_internalauthor": ["Smith, Bob"], "utb_identifier_wok": "000375229700041"}, {"resource_id": 4},
    )
    got = {r.resource_id: (set(r.issues or {}), r.status) for r in validate.validation_issues(df, spark.createDataFrame([("Novak, Jan",)], "name string")).collect()}
    assert got[1] == (set(), "ok") and got[4] == (set(), "ok")
    assert got[2] == ({"trailing_spaces", "double_space", "invalid_doi", "invalid_wos_id", "pipe_in_field"}, "has_issues")
    assert got[3] == ({"brackets_in_title", "internal_not_in_authors", "authors_not_in_registry"}, "has_issues")
    fixes = {(r.resource_id, r.field_name): r.suggested for r in validate.suggested_fixes(df).collect()}
    assert fixes == {(2, "dc_title"): ["Title"], (2, "dc_identifier_doi"): ["10.1234/x"]}
    fixed = validate.apply_fixes(df, validate.suggested_fixes(df)).filter("resource_id = 2").first()
    assert fixed.dc_title == ["Title"] and fixed.dc_identifier_doi == ["10.1234/x"]
    assert validate.validation_issues(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Received: 15 March 2018; Accepted: 20 June 2018", {"received": date(2018, 3, 15), "accepted": date(2018, 6, 20), "status": "processed"}),
        ("Received: March 2019; Accepted: June 2019", {"received": date(2019, 3, 1), "status": "processed"}), ("2018", {"status": "year_only", "needs_llm": True}), ("", {"status": "empty", "needs_llm": False}),
        ("June 2018", {"status": "no_labels", "needs_llm": True}), ("Received: 20 June 2018; Accepted: 10 January 2018", {"needs_llm": True, "flag_keys": ["chrono_warnings"]}),
        ("Received: 00th; Accepted: 20 June 2018", {"flag_keys": ["placeholder_dates"]}), ("Received: 15.03.2018; Accepted: 20.06.2018", {"mdr_format": "DMY"}),
        ("Published: 28.10.2002", {"mdr_format": "DMY", "mdr_confidence": "high"}), ("Received: 7.2.2002; Accepted: 3.5.2002", {"mdr_confidence": "medium", "needs_llm": False}),
        ("Published: 10.5.2002", {"mdr_confidence": "low", "needs_llm": True}), ("Accepted: 7.30.2002", {"mdr_format": "MDY", "accepted": date(2002, 7, 30)}),
        ("Received: 28.10.2002; Accepted: 7.30.2002", {"mdr_confidence": "invalid", "needs_llm": True}), ("1st Revision: 2 May 2019", {"reviewed": date(2019, 5, 2)}),
    ],
)
def test_fulltext_dates(text, want):
    got = D.extract(text)
    assert {k: got[k] for k in want} == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(D.MILESTONES), st.none() | st.dates(date(1990, 1, 1), date(2030, 12, 31)), st.none() | st.dates(date(1990, 1, 1), date(2030, 12, 31))), max_size=6))
def test_order_resolver_is_consistent(candidates):
    order, confidence, _ = D.resolve_order(candidates)
    assert (order is None) == (confidence in (None, "low", "invalid"))
    if order == "DMY":
        assert not any(m and not d for _, d, m in candidates)


def test_date_stage(records):
    df = records({"resource_id": 1, "utb_fulltext_dates": ["Received: 1 May 2018", "Accepted 2 June 2018"]}, {"resource_id": 2})
    got = {r.resource_id: r for r in dates.extract_dates(df).collect()}
    assert got[1].accepted == date(2018, 6, 2) and got[2].status == "empty"
    assert dates.date_status(dates.extract_dates(df)).count() == 2


def test_affiliations(spark):
    home = Settings(home_keywords=("home univ",))
    wos = spark.createDataFrame([("[Novak, J; Smith, B] Home Univ, Town; [Lee, K] Other Univ; ",), ("Home Univ",), ("",)], "x string").select(affiliations.wos_blocks(F.col("x"), home).alias("b")).collect()
    assert [(b.authors, b.affiliation, b.is_home) for b in wos[0].b] == [(["Novak, J", "Smith, B"], "Home Univ, Town", True), (["Lee, K"], "Other Univ", False)]
    assert [(b.authors, b.is_home) for b in wos[1].b] == [([], True)] and wos[2].b is None
    text = "Novak J.A., Dep. A, Other Univ, Italy, Home Univ, Town, Czech Republic; Faculty of X, Home Univ; Di Martino A., Univ Y, Spain"
    sc = spark.createDataFrame([(text,)], "x string").select(affiliations.scopus_blocks(F.col("x"), home).alias("b")).first().b
    assert [(b.author, b.affiliation, b.is_home) for b in sc] == [
        ("Novak J.A.", "Dep. A, Other Univ, Italy", False), ("Novak J.A.", "Home Univ, Town, Czech Republic", True), (None, "Faculty of X, Home Univ", True), ("Di Martino A.", "Univ Y, Spain", False),
    ]


REGISTRY = "author_id bigint, display_name string, other_name string, surname string, given_name string, orcid string, scopusid string, wos_id string, organization_id int, faculty string"


def registry(spark, *people):
    return spark.createDataFrame([(i, n, o, None, None, orcid, sc, w, None, None) for i, n, o, orcid, sc, w in people], REGISTRY)


@pytest.mark.parametrize(
    ("name", "kind"),
    [
        ("Sedlarik Vladimir", "exact_normalized"), ("Sedlarik V", "initial_surname"), ("Novak J", "ambiguous_initials"), ("Novak", "ambiguous_surname"), ("Vavra Ambrozova, Jarmila", "exact"),
        ("Danko, Martin", "initial_mismatch"), ("0000-0001-2345-6789", "orcid"), ("author id 12345678901", "scopus_id"), ("ResearcherID RID-4567-2024", "wos_id"), ("Nobody, X", "none"),
    ],
)
def test_match_cascade(spark, name, kind):
    reg = registry(
        spark, (1, "Sedlařík Vladimír", None, "0000-0001-2345-6789", None, None), (2, "Novak, Jan", None, None, "12345678901", None), (3, "Novak, Jiri", None, None, None, "RID-4567-2024"),
        (4, "Vavra, Jarmila", "Vavra Ambrozova, Jarmila||Ambrozova, Jarmila", None, None, None), (5, "Danko, Lukas", None, None, None, None),
    )
    got = authors.match_names(spark.createDataFrame([(name,), (name,), ("",), (None,)], "name string"), reg).collect()
    assert [(r.match_type, r.author_id is not None) for r in got] == [(kind, kind not in ("ambiguous_initials", "ambiguous_surname", "initial_mismatch", "none"))]


def test_merge_names(spark):
    df = spark.createDataFrame([(1, 0, "Grant B"), (1, 1, "Pfleger, Jiri"), (1, 2, "Grant, Benjamin"), (1, 3, "Pfleger, Jiri"), (1, 4, "")], "resource_id bigint, pos int, name string")
    assert rows(authors.merge_names(df)) == [(1, ["Grant, Benjamin", "Pfleger, Jiri"])]


def test_author_inputs(records, spark):
    df = records(
        {"resource_id": 1, "dc_contributor_author": ["Novák, Jan", "Lee K"], "utb_source": ["j-wok", "j-scopus"], "utb_wos_affiliation": ["[Novak, J; Smith, Bob] Univ X"]},
        {"resource_id": 2, "dc_contributor_author": ["Only, One"], "utb_source": ["j-scopus"]}, {"resource_id": 3},
    )
    past = records({"resource_id": 9, "dc_contributor_author": ["Lee, Kim"], "utb_source": ["j-wok"]}).select("*", F.lit(1).alias("dedup_kept_resource_id"))
    got = {(r.resource_id, r.source): r.names for r in authors.source_lists(df, past).groupBy("resource_id", "source").agg(F.sort_array(F.collect_list("name")).alias("names")).collect()}
    assert got[1, "wos"] == ["Lee, Kim"] and (1, "scopus") not in got and got[2, "scopus"] == ["Only, One"] and sorted(got[1, "repo"]) == ["Lee K", "Lee, Kim", "Novák, Jan"]
    blocks = affiliations.affiliation_blocks(df)
    names = {r.resource_id: r.names for r in authors.author_inputs(df, blocks, past).collect()}
    assert names == {1: ["Lee, Kim", "Novák, Jan", "Smith, Bob"], 2: ["Only, One"]}
    assert rows(authors.align_blocks(df, blocks)) == [(1, 0, "Novák, Jan", "wos", "Univ X")]
    assert rows(affiliations.block_warnings(df)) == [(1, 1, 0, True)]
    parts = spark.createDataFrame([("Dep. A, Faculty B, Some University, Town",)], "x string").select(affiliations.scopus_parts(F.col("x")).alias("p")).first().p
    assert tuple(parts) == ("Dep. A", "Faculty B", "Some University")


def test_author_inputs_of_equal_positions(records, spark):
    df = records({"resource_id": 1})
    merged = [(7, "2025-02-01", ["Zeman, Karel", "ADAM, Petr"]), (5, "2025-03-01", ["Bílý, Ota", "Adam, Petr"]), (6, "2025-03-01", ["Abel, Ivo", "Cibulka, Jan"]), (7, "2025-04-01", ["Aron, Jan"])]
    for order in (merged, merged[::-1]):
        past = spark.createDataFrame(order, "resource_id bigint, at string, dc_contributor_author array<string>").coalesce(1).select(
            "resource_id", "dc_contributor_author", F.array(F.lit("j-wok")).alias("utb_source"), F.lit(1).alias("dedup_kept_resource_id"), F.to_timestamp("at").alias("dedup_merged_at"))
        assert authors.author_inputs(df, affiliations.affiliation_blocks(df), past).first().names == ["Zeman, Karel", "Bílý, Ota", "Abel, Ivo", "ADAM, Petr", "Cibulka, Jan"]


def test_summaries_and_candidates(spark):
    reg = registry(spark, (1, "Novák, Jan", None, None, None, None), (2, "Novak, Jan", None, None, None, None))
    assert rows(review.author_summaries(reg)) == [("novak, jan", 2, 2, "")]
    scored = spark.createDataFrame([(1, f"n{i:02}", 1.0 if i < 3 else 0.0) for i in range(15)], "resource_id bigint, name string, score double")
    assert review.top_candidates(scored, 2, 10).count() == 10 and review.top_candidates(scored, 2, 1).count() == 2
    assert snapshots.rename_legacy(spark.createDataFrame([(1,)], "old int"), {"old": "new"}).columns == ["new"]


def test_attribution(spark):
    people = spark.createDataFrame([(1, a, a) for a in range(1, 6)] + [(2, 9, 0)], "resource_id bigint, author_id bigint, pos int")
    found = spark.createDataFrame([(1, a, "wos", "F", "U") for a in range(1, 5)] + [(1, 1, "scopus", "G", "V")], "resource_id bigint, author_id bigint, source string, faculty string, ou string")
    found = found.filter("not (author_id = 1 and source = 'scopus')")
    defaults = spark.createDataFrame([(5, "F", "X"), (2, "H", "Y"), (9, None, None)], "author_id bigint, faculty string, ou string")
    got = {(r.resource_id, r.author_id): r for r in authors.attribute(people, found, defaults).collect()}
    assert (got[1, 5].method, got[1, 5].ou, got[1, 5].confidence) == ("cohort", "U", pytest.approx(0.68))
    assert got[1, 2].conflict and got[1, 2].method == "verified_wos" and got[2, 9].method == "unresolved"


def test_workplaces(spark):
    from scriptorium.plans.pipeline import workplaces

    units = spark.createDataFrame([(1, "Faculty of Zoology", None), (2, "Faculty of Arts", None), (3, "Department of Art Theory", 2), (4, "Department of Animal Biology", 1)], "id bigint, name string, parent_id bigint")
    texts = ["Department of Art Theory, Faculty of Zoology, Home", "Departmemt of Art Theory, Home", "Home; Department of Animal Biology", "Elsewhere"]
    blocks = spark.createDataFrame([(i, "wos", "Novák, Jan", t) for i, t in enumerate(texts)] + [(0, "wos", "Novák, Jan", "Department of Animal Biology")], "resource_id bigint, source string, author string, affiliation string")
    people = spark.createDataFrame([(i, 7, "Novák, Jan") for i in range(len(texts))], "resource_id bigint, author_id bigint, name string")
    got = [(r.resource_id, r.faculty, r.ou) for r in workplaces(blocks, people, units).collect()]
    assert sorted(got) == [(0, "Faculty of Zoology", "Department of Animal Biology"), (1, "Faculty of Arts", "Department of Art Theory"), (2, "Faculty of Zoology", "Department of Animal Biology")]


def test_tree(spark):
    nodes = spark.createDataFrame([(1, "University", None), (2, "University Institute", 1), (3, "Centre of Polymer Systems", 2), (4, "Loop", 5), (5, "Loop b", 4)], "id bigint, name string, parent_id bigint")
    paths = tree.closure(nodes)
    assert rows(paths.filter("node = 3")) == [(3, 1, 2), (3, 2, 1), (3, 3, 0)]
    assert rows(paths.filter("node = 4")) == [(4, 4, 0), (4, 5, 1)]
    assert rows(tree.first_ancestor(paths, nodes.filter("id = 2")))[-1] == (3, 2)
    texts = spark.createDataFrame([("Center of Polymer Systems",), ("Random Department",), ("University Institute",)], "text string")
    assert [(t, i) for t, i, _ in rows(tree.find_nodes(texts, nodes.select("id", "name")))] == [("Center of Polymer Systems", 3), ("University Institute", 2)]


def test_journals(records, spark):
    df = records(
        {"resource_id": 1, "dc_identifier_issn": "1111-2222", "dc_relation_ispartof": "Right", "dc_publisher": "P", "utb_scopus_affiliation": "x"}, {"resource_id": 2, "dc_identifier_issn": "1111-2222", "dc_relation_ispartof": "Wrong"},
        {"resource_id": 3, "dc_identifier_issn": "1111-2222", "dc_relation_ispartof": "Wrong"}, {"resource_id": 4, "dc_relation_ispartof": "Alone"}, {"resource_id": 5, "dc_identifier_isbn": "123456789X", "dc_relation_ispartof": "Book"},
    )
    got = {r.resource_id: (r.proposed_journal, r.proposed_publisher, r.status) for r in journals.propose(df).collect()}
    assert got == {1: (None, None, "no_change"), 2: ("Right", "P", "has_proposal"), 3: ("Right", "P", "has_proposal"), 4: (None, None, "no_change"), 5: (None, None, "no_change")}
    lookup = providers.static_lookup(spark, {"1111-2222": ("Q", "Looked Up")})
    assert journals.propose(df, lookup).filter("resource_id = 1").first().proposed_journal == "Looked Up"
    assert journals.apply_proposals(df, journals.propose(df)).filter("resource_id = 2").first().dc_relation_ispartof == ["Right"]


def test_exact_duplicates(records):
    df = records({"resource_id": 1, "dc_identifier_doi": "10.1234/ABC"}, {"resource_id": 2, "dc_identifier_doi": "10.1234/abc "}, {"resource_id": 3, "dc_identifier_doi": "10.9999/xyz"}, {"resource_id": 4, "dc_identifier_doi": [""]}, {"resource_id": 5, "dc_identifier_doi": [""]})
    assert rows(dedup.exact_groups(df, "dc_identifier_doi")) == [("10.1234/abc", 1, 2)]
    assert rows(dedup.exact_members(df, "dc_identifier_doi")) == [("10.1234/abc", 1, 2)]
    with pytest.raises(ValueError):
        dedup.exact_groups(df, "dc_title")


def test_content_links(records):
    base = {"dc_title": "Thermal study of modern polymer science", "dc_contributor_author": ["A, B"], "dc_description_abstract": "text", "dc_identifier_issn": "1111-2222", "utb_relation_volume": "1", "dc_type": "article"}
    df = records(
        {"resource_id": 1, **base}, {"resource_id": 2, **base, "dc_title": "Thermal study of modern polymer sciences"}, {"resource_id": 3, **base}, {"resource_id": 4, **base, "utb_relation_volume": None},
        {"resource_id": 5, **base, "dc_identifier_issn": None, "dc_type": "conferenceobject"}, {"resource_id": 6, "dc_title": base["dc_title"]}, {"resource_id": 7, "dc_title": base["dc_title"]}, {"resource_id": 8, **base, "dc_contributor_author": ["Other, C"]},
    )
    got = {(r.id_a, r.id_b): r.match_type for r in dedup.content_links(df).collect()}
    assert got[1, 3] == "exact:content" and got[1, 2] == "exact:content" and got[1, 4] == "early_access" and got[1, 5] == "merged_type"
    assert not any(8 in p or 6 in p or 7 in p for p in got)


def test_fuzzy_links_against_brute_force(records):
    titles = ["aging of polymer films", "ageing of polymer films", "aging of polymer film", "soil remediation", "soil remediations", "aging of polymer films"]
    years = ["2020", "2020", "2018", "2019", "2020", None]
    df = records(*[{"resource_id": i, "dc_title": t, "dc_date_issued": y, "dc_identifier_issn": "1111-2222" if i < 2 else None} for i, (t, y) in enumerate(zip(titles, years))])
    near = lambda a, b: (a is None and b is None) or (a and b and abs(int(a) - int(b)) <= 1)
    want = {(i, j) for i in range(6) for j in range(i + 1, 6) if near(years[i], years[j]) and jaro_winkler(titles[i], titles[j]) >= 0.85}
    got = {(r.id_a, r.id_b): r.match_type for r in dedup.fuzzy_links(df).collect()}
    assert set(got) == want and got[0, 1] == "fuzzy_title+issn"


def test_fuzzy_links_of_many_parts(records, monkeypatch):
    monkeypatch.setattr(dedup, "FUZZY_PART", 5)
    words = ["aging", "ageing", "of", "polymer", "polymers", "film", "films", "fľms", "x" * 70, "y" * 300]
    draw = random.Random(3)
    given = [(" ".join(draw.choices(words[:8] if i % 6 else words, k=draw.randint(1, 5))), draw.choice([None, "2018", "2019", "2020", "2022"]), draw.choice([None, "1111-2222", "3333-4444"])) for i in range(90)]
    df = records(*[{"resource_id": i, "dc_title": t, "dc_date_issued": y, "dc_identifier_issn": n} for i, (t, y, n) in enumerate(given)])
    form = {r.resource_id: r.title for r in df.select("resource_id", X.title_form(F.col("dc_title")[0]).alias("title")).collect()}
    first = {}
    for i, (_, y, n) in enumerate(given):
        first.setdefault((form[i], y, n), i)
    near = lambda a, b: (a is None and b is None) or (a and b and abs(int(a) - int(b)) <= 1)
    want = {(rep, i): 1.0 for i, (_, y, n) in enumerate(given) if (rep := first[form[i], y, n]) != i}
    for i, j in itertools.combinations(sorted(first.values()), 2):
        if near(given[i][1], given[j][1]) and (score := jaro_winkler(form[i], form[j])) >= 0.85:
            want[i, j] = round(score, 4)
    links = dedup.fuzzy_links(df)
    got = [((r.id_a, r.id_b), r.match_type, r.score) for r in links.collect()]
    assert len(got) == len(want) and {p: s for p, _, s in got} == pytest.approx(want, abs=1e-4)
    assert all((k == "fuzzy_title+issn") == bool(given[i][2] and given[i][2] == given[j][2]) for (i, j), k, _ in got)
    assert "ArrowEvalPython" not in links._jdf.queryExecution().optimizedPlan().toString()  # no call for each pair


def test_plan():
    assert dedup.plan_fold([(1, 2), (2, 3)]) == [(1, 2), (1, 3)]
    assert dedup.plan_fold([(10, 20), (5, 20)]) == [(10, 20), (10, 5)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)).filter(lambda p: p[0] != p[1]), max_size=14))
def test_plan_deletes_each_once_and_never_a_survivor(actions):
    plan = dedup.plan_fold(actions)
    gone = [d for _, d in plan]
    assert len(set(gone)) == len(gone)
    alive = set(range(10))
    for keep, delete in plan:
        assert keep in alive
        alive.discard(delete)


def test_merge(records, spark):
    df = records({"resource_id": 1, "dc_title": [""], "utb_source": ["a"], "dc_publisher": None}, {"resource_id": 2, "dc_title": "T", "utb_source": ["b", "A"]}, {"resource_id": 3, "dc_publisher": "P", "utb_source": ["c"]}, {"resource_id": 4, "dc_title": "other"})
    actions = spark.createDataFrame([(0, 1, 2), (1, 2, 3), (2, 4, 99)], "seq bigint, kept_id bigint, deleted_id bigint")
    plan = dedup.plan_merges(actions)
    assert [(k, d) for _, k, d, _ in rows(plan)] == [(1, 2), (4, 99), (1, 3)] or sorted((r.kept_id, r.deleted_id) for r in plan.collect()) == [(1, 2), (1, 3), (4, 99)]
    kept, history = dedup.merge_records(df, plan)
    one = kept.filter("resource_id = 1").first()
    assert (one.dc_title, one.dc_publisher, one.utb_source) == (["T"], ["P"], ["a", "b", "c"])
    assert sorted(r.resource_id for r in kept.collect()) == [1, 4] and history.count() == 4


def test_content_links_and_merges_are_computed_once(records):
    base = {"dc_title": "Thermal study of modern polymer science", "dc_contributor_author": ["A, B"], "dc_description_abstract": "text", "dc_identifier_issn": "1111-2222", "utb_source": ["a"]}
    df = records({"resource_id": 1, **base}, {"resource_id": 2, **base, "utb_source": ["b"]}, {"resource_id": 3, **base, "dc_title": base["dc_title"] + "s"}, {"resource_id": 4, "dc_title": base["dc_title"]}, {"resource_id": 5, "dc_title": base["dc_title"]})
    planned = lambda x: x._jdf.queryExecution().optimizedPlan().toString()
    links = dedup.content_links(df)
    assert "dc_description_abstract" not in planned(links)  # no long text behind the keys
    assert sorted((r.id_a, r.id_b) for r in links.collect()) == [(1, 2), (1, 3)]
    chosen = dedup.survivor(links, df)
    plan = dedup.plan_merges(chosen.select(F.struct("id_a", "id_b", "match_type").alias("seq"), "kept_id", "deleted_id"))
    assert "ArrowEvalPython" not in planned(plan)
    kept, history = dedup.merge_records(df, plan)
    assert "FlatMapGroupsInArrow" not in planned(kept)
    assert {r.resource_id: r.utb_source for r in kept.collect()} == {1: ["a", "b"], 4: None, 5: None}


def test_history_is_cut_from_the_plan(records, spark):
    df = records({"resource_id": 1, "dc_title": "T"}, {"resource_id": 2, "dc_title": "T"}, {"resource_id": 3, "dc_title": "other"})
    history = dedup.merge_records(df, dedup.plan_merges(spark.createDataFrame([(0, 1, 2), (1, 3, 99)], "seq bigint, kept_id bigint, deleted_id bigint")))[1]
    assert "FlatMapGroupsInArrow" not in history._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.resource_id, r.dedup_kept_resource_id, r.dedup_other_resource_id) for r in history.collect()) == [(1, 1, 2), (2, 1, 2)]


def test_review(records, spark):
    df = records(
        {"resource_id": 1, "dc_identifier_doi": "10.1/a", "utb_source": ["j-wok"], "dc_title": "Polymer study"}, {"resource_id": 2, "dc_identifier_doi": "10.1/A", "utb_source": ["j-riv"]},
        {"resource_id": 3, "utb_source": ["j-wok", "j-scopus"]}, {"resource_id": 4, "utb_source": ["j-scopus"], "withdrawn": True}, {"resource_id": 5},
    )
    assert rows(review.list_groups(df)) == [(1, "existing"), (3, "duplicate"), (5, "single")]
    assert [r.resource_id for r in review.search(df, "p_lymer").collect()] == [1]
    ddl = "id bigint, resource_id bigint, field_key string, target_table string, old_value string, new_value string, created_at timestamp, approved_at timestamp, discarded_at timestamp"
    t = datetime(2024, 1, 1)
    events = spark.createDataFrame([(1, 1, "dc.title", "utb_metadata_arr", "", "Old", t, None, None), (2, 1, "dc.title", "utb_metadata_arr", "", "Pending title", t, None, None), (2, 1, "dc.title", "utb_metadata_arr", "", "Pending title", t, None, None), (3, 1, "dc.title", "utb_metadata_arr", "", "Gone", t, None, t)], ddl)
    shown = {(r.resource_id, r.field_key): (r.shown, r.is_pending) for r in review.overlay(df, events).collect()}
    assert shown[1, "dc.title"] == ("Pending title", True) and shown[2, "dc.title"] == (None, False)
    new, stamped = review.approve(df, events, df.filter("resource_id = 1"))
    assert new.filter("resource_id = 1").first().dc_title == ["Pending title"] and review.pending_changes(stamped).count() == 0
    assert df.filter("resource_id = 1").first().dc_title == ["Polymer study"]
    p = review.proposed_value(spark.createDataFrame([(" ", "b", "c")], "x string, y string, z string"), ("x", "y", "z")).first()
    assert (p.proposed, p.proposed_by) == ("b", "y")
    flags = spark.createDataFrame([(1, '[{"other": 2, "match_type": "m", "score": 1.0}]', "broken"), (2, None, None)], "resource_id bigint, a string, b string")
    assert rows(review.duplicate_matches(flags, ("a", "b"))) == [(1, 2, "m", 1.0)]


def test_crossref(spark):
    message = {"title": ["A title"], "page": "12-34", "author": [{"family": "Novák", "given": "Jan"}, {"name": "Team"}], "published-online": {"date-parts": [[2020, 3, 5]]}, "issued": {"date-parts": [[2020]]}, "abstract": "<jats:p>Text</jats:p>", "issn-type": [{"value": "1111-2222", "type": "print"}], "funder": [{"name": "GA", "award": ["1", "2"]}]}
    got = crossref.work_fields(spark.createDataFrame([(json.dumps(message),), ("broken",)], "message string")).collect()
    a = got[0]
    assert (a.dc_title, a.dc_citation_spage, a.dc_citation_epage, a.dc_contributor_author, a.dc_date_issued, a.dc_description_abstract, a.issn_types, a.funders) == ("A title", "12", "34", "Novák, Jan||Team", "2020-03-05", "Text", "1111-2222 (print)", "GA (1, 2)")
    assert got[1].dc_title is None


def test_completion(spark):
    assert completion.salvage_json('Sure: ```json\n{"a": {"b": 1}}\n```') == {"a": {"b": 1}}
    assert completion.check_dates({"received": "2024-01-01", "accepted": "bad"}, "2024")["received"] == ""
    with pytest.raises(ValueError):
        completion.check_dates({"other": "x"})
    made = completion.check_authors({"authors": [{"name": "Novak Jan", "faculty": "FMT", "ou": "Dept of Polymer"}, {"name": "Ghost Writer"}]}, {"novak jan": "Novák, Jan"}, {"FMT": "Faculty"}, ["Dept of Polymers"])
    assert made == [{"name": "Novák, Jan", "faculty": "Faculty", "ou": "Dept of Polymers"}]
    todo = completion.date_prompt(spark.createDataFrame([(1, "Received 2 May 2019"), (2, "x")], "resource_id bigint, raw string"))
    out = {r.resource_id: r for r in completion.complete_dates(todo, lambda p: '{"received": "2019-05-02"}' if "Record 1" in p else "no json").collect()}
    assert out[1].received == "2019-05-02" and out[2].status == "validation_error"
    asked = completion.author_prompt(spark.createDataFrame([(1, ["Novák, Jan"], ["Dept of Polymers"], ["Novák, Jan"])], "resource_id bigint, names array<string>, affiliations array<string>, candidates array<string>"))
    answer = completion.complete_authors(asked, lambda p: '{"authors": [{"name": "novák, jan", "faculty": "F", "ou": "Dept of Polymer"}, {"name": "Ghost Writer"}]}', {"F": "Faculty"}, ["Dept of Polymers"]).first()
    assert (answer.status, answer.names, answer.faculties, answer.ous) == ("processed", ["Novák, Jan"], ["Faculty"], ["Dept of Polymers"])
    assert providers.retry_delay(0, 429) == 10.0 and providers.retry_delay(1, 500, {"Retry-After": "7"}) == 7.0


def test_schema_and_sources(spark, tmp_path):
    assert schema.spark_type("character varying(20)[]").simpleString() == "array<string>"
    with pytest.raises(ValueError):
        schema.spark_type("polygon")
    df = spark.createDataFrame([("a", 1)], "`dc.title` string, resource_id bigint")
    assert schema.undotted(df).columns == ["dc_title", "resource_id"]
    (tmp_path / "seed.csv").write_text("﻿resource_id;dc.publisher\n1;{a,\"b c\"}\n2;plain\n", encoding="utf-8")
    got = snapshots.read_seed(spark, str(tmp_path / "seed.csv"), ["dc_publisher"])
    assert rows(got) == [("1", ["a", "b c"]), ("2", ["plain"])]
    assert [r.j for r in snapshots.migrate_json(spark.createDataFrame([("{}",), ("x",), (None,)], "j string"), "j").collect()] == ["{}", '{"raw":"x"}', "{}"]
    assert Settings.from_env({"SCRIPTORIUM_COHORT_SHARE": "bad", "SCRIPTORIUM_HOME_KEYWORDS": "a, b"}) == Settings(home_keywords=("a", "b"))


def test_commands_and_stream(records, spark, tmp_path):
    from scriptorium.plans import pipeline
    from scriptorium.streaming import incremental

    source = str(tmp_path / "source")
    records({"resource_id": 1, "dc_title": "A study of one thing", "dc_contributor_author": ["A, B"], "dc_identifier_doi": "10.1/a", "dc_identifier_issn": "1111-2222"}, {"resource_id": 2, "dc_title": "A study of one thing", "dc_contributor_author": ["A, B"], "dc_identifier_doi": "10.1/A", "dc_identifier_issn": "1111-2222"}).write.parquet(source)
    w = str(tmp_path / "w")
    for command in (["bootstrap-local-db", "--source", source], ["setup-processing-queue"], ["validate-metadata"], ["extract-dates"], ["normalize-journals"], ["deduplicate-records"], ["metadata-validation-status"]):
        pipeline.main([*command, "--workspace", w], spark)
    space = pipeline.Workspace(spark, w)
    assert [r.resource_id for r in space.read("records").collect()] == [1]
    past = space.read("history").select("resource_id", "dedup_match_type", "dedup_kept_resource_id", "dedup_other_resource_id").collect()
    assert sorted(tuple(r) for r in past) == [(1, "exact:content", 1, 2), (2, "exact:content", 1, 2)] and not space.read("history").filter("dedup_merged_at is null").count()
    spark.range(1).write.parquet(f"{w}/records/v99")
    (tmp_path / "w" / "records" / "v99" / "_SUCCESS").unlink()  # a write that was cut off
    assert [r.resource_id for r in space.read("records").collect()] == [1]
    stream = incremental.record_stream(spark, source, spark.read.parquet(source).schema)
    q = incremental.run_stage(stream, validate.validation_issues, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_life_of_statuses(records, spark, tmp_path, monkeypatch):
    import sys
    import types

    from scriptorium.plans import pipeline

    asked = types.ModuleType("asked")  # what commands are told to ask
    asked.dates = lambda prompt: 'Sure: {"published": "2011-02-03"}'
    asked.journal = lambda key: ("Press", "Asked Journal") if key == "1111-2222" else None
    monkeypatch.setitem(sys.modules, "asked", asked)
    w, source = str(tmp_path / "w"), str(tmp_path / "source")
    records({"resource_id": 1, "dc_title": "Fine", "dc_identifier_issn": "1111-2222", "dc_relation_ispartof": "J", "utb_fulltext_dates": "Published somewhen"}, {"resource_id": 2, "dc_title": "Blank ", "dc_identifier_issn": "3333-4444", "dc_relation_ispartof": "K"}).write.parquet(source)
    run = lambda *c: pipeline.main([*c, "--workspace", w], spark)
    space = pipeline.Workspace(spark, w)
    status = lambda name: {r.resource_id: r.status for r in space.read(name).collect()}
    run("bootstrap-local-db", "--source", source)
    run("validate-metadata", "--limit", "1")
    assert status("validation") == {1: "ok"}
    run("validate-metadata")
    assert status("validation") == {1: "ok", 2: "has_issues"}
    run("apply-validation-fixes")
    assert status("validation") == {1: "ok", 2: "not_checked"} and space.read("fixes").count() == 0
    run("validate-metadata")
    assert status("validation") == {1: "ok", 2: "ok"}
    run("extract-dates")
    run("extract-dates-llm", "--completer", "asked:dates")
    assert str(space.read("dates_merged").filter("resource_id = 1").first().published) == "2011-02-03"
    run("normalize-journals", "--lookup", "openalex=asked:journal")
    assert status("journals") == {1: "has_proposal", 2: "no_change"}
    monkeypatch.setattr(pipeline, "ask_user", lambda group: False)
    run("apply-journal-normalization", "--interactive")
    assert status("journals") == {1: "has_proposal", 2: "no_change"}
    run("apply-journal-normalization")
    assert status("journals") == {1: "applied", 2: "no_change"}
    assert space.read("records").filter("resource_id = 1").first().dc_relation_ispartof == ["Asked Journal"]
    with pytest.raises(SystemExit):
        run("detect-authors-llm")


def test_waiting_is_what_the_provider_says():
    waits, answers = [], iter([providers.ProviderError("slow", 429), providers.ProviderError("slow", 503, {"Retry-After": "3"}), OSError("gone"), "done"])

    def call():
        if isinstance(x := next(answers), Exception):
            raise x
        return x

    assert providers.with_retries(call, 3, 1.5, waits.append) == "done" and waits == [10.0, 3.0, 4.5]


def test_long_chains_are_one_component(spark):
    edges = [(0, 200), *[(i, i - 1) for i in range(200, 1, -1)]]
    got = dedup.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").agg(F.min("component"), F.max("component"), F.count("*")).first()
    assert tuple(got) == (0, 0, 201)
    with pytest.raises(RuntimeError):
        dedup.components(spark.createDataFrame(edges, "a long, b long"), "a", "b", max_rounds=1)


def test_english_names_and_person_data(spark):
    units = spark.createDataFrame([(1, "EN_1", "Fakulta umění"), (2, "Faculty of Law", "Právo"), (3, "", "Neznámá"), (4, None, "fakulta  UMENI")], "id int, name_en string, name_cs string")
    words = spark.createDataFrame([("Fakulta umění", "Faculty of Arts")], "czech string, english string")
    assert rows(authors.english_names(units, words)) == [(1, "Faculty of Arts"), (2, "Faculty of Law"), (3, None), (4, "Faculty of Arts")]
    tree_ = spark.createDataFrame([(1, "Faculty of Arts", None), (5, "Studio", 1), (6, "Large Studio", 1)], "id int, name string, parent_id int")
    registry = spark.createDataFrame([(7, "fakulta umeni || Nowhere", 5), (7, None, 6), (8, None, 1)], "author_id long, faculty string, organization_id int")
    assert rows(authors.person_data(registry, tree_, words)) == [(7, ["Faculty of Arts"], "Large Studio"), (8, [], None)]
