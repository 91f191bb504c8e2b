"""Reference lists, containers, mixtures."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from scriptorium.llm import canonical as C, mixing as X, packing as P, tokens

REFERENCE = [
    (1, "faculty", "Faculty of Visual Arts", "Fakulta výtvarných umění", "FVA"), (2, "faculty", "Faculty of Social Sciences", "Fakulta společenských věd", "FSS"),
    (3, "faculty", "Faculty of Economics", "Ekonomická fakulta", None), (10, "ou", "Department of Art Theory", "Ústav teorie umění", None), (20, "journal", "Journal of Modern Rubber Composites", None, None), (21, "journal", "Theoretical Signal Filtering Review", None, None), (22, "journal", "Signal Filtering Review", None, None),
]
CASES = {
    "faculty": {"Faculty of Visual Arts.": 1, "fac. of visual arts": 1, "Visual Arts, Faculty of": 1, "F.V.A.": 1, "fva utb": 1, "fakulta vytvarnych umeni": 1, "Fac Vis Arts": 1, "Facutly of Visual Atrs": 1, "Visual Arts": 1, "Social Sciences UTB Borovice": 2, "Rectorate": 0, "?": 0, "Faculty of Veterinary Hygiene": 0,
                **{f"Faculty of {name}{tail}": k for k, name in ((1, "Visual Arts"), (2, "Social Sciences"), (3, "Economics")) for tail in (", UTB", " UTB Borovice")}},
    "ou": {"Dept. of Art Theory": 10, "Dpt. of Art Theory": 10, "Art Theory": 10, "Department off Art Theory": 10, "Department of Theology": 0},
    "journal": {"Jnl Of Modern Rubber Composites": 20, "Jou. Mod. Rub. Com.": 20, "The Journal of Modern Rubber Composites (Online)": 20, "Journal of Rubber Composites": 0, "The. Sig. Fil. Rev.": 21, "The Signal Filtering Review": 22, "Journal of Modern Rubber Composites, vol. 12": 20},
    "nothing": {"x": 0},
}


def test_mapping(spark):
    ref = spark.createDataFrame(REFERENCE, "ref_id int, kind string, canonical_name string, alt_name string, short_code string")
    values = spark.createDataFrame([(k, v, "clash") for k, vs in CASES.items() for v in [*vs, *vs, "", None, "  "]], "kind string, value string, ref_id string")
    got = {(r.kind, r.value): r.ref_id for r in C.map_to_reference(values, ref).collect()}
    assert got == {(k, v): r for k, vs in CASES.items() for v, r in vs.items()}
    assert C.map_to_reference(values.limit(0), ref).count() == 0
    assert {r.ref_id for r in C.map_to_reference(values, ref.limit(0)).collect()} == {0}


def test_p7(spark, records):
    ref = spark.createDataFrame(REFERENCE, "ref_id int, kind string, canonical_name string, alt_name string, short_code string")
    entries = spark.createDataFrame([(1, 1, "n", "FVA", None), (1, 2, "n", "Faculty of Visual Arts", ""), (1, 2, "n", "Faculty of Visual Arts", "")], "resource_id bigint, entry_pos int, name string, faculty string, ou string")
    df = records({"resource_id": 5, "dc_relation_ispartof": ["Unknown Title", None, "Journal of Modern Rubber Composites"]}, {"resource_id": 6})
    assert sorted(tuple(r) for r in C.p7_found(entries, df, ref).collect()) == [("dc_relation_ispartof", 5, 1, 0), ("faculty", 1, 1, 1)]


def test_near():
    assert C.near("abcd", "abdc", 1) and C.near("abcd", "abc", 1) and not C.near("abcd", "badc", 1) and C.near("abcd", "badc", 2)


def test_every_candidate_is_looked_at():
    """Sixty entries share more with the value than the one meant."""
    entries = [(i, [f"Annals of Polymers {'abcdefghijklmnopqrst'[i % 20] * 3}{i} Polymer Annals"], None) for i in range(1, 61)]
    m = C.Matcher([*entries, (99, ["Annals of Polymers"], None)], False)
    assert m.match("Anals of Polymers")[0] == 99 and m.match("Annals of Polymer")[0] == 99


def brute_near(a, b):
    """Edits between two words, swaps of neighbours count once."""
    d = {(i, j): i or j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="abc", max_size=9), st.text(alphabet="abc", max_size=9))
def test_near_against_brute_force(a, b):
    assert [C.near(a, b, most) for most in (1, 2)] == [brute_near(a, b) <= most for most in (1, 2)]


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_no_candidate_that_fits_is_left_out(data):
    names = [f"{a} {b} of {c}" for a in ("annals", "journal") for b in ("applied polymers", "rubber", "signal filtering") for c in ("letters", "europe")]
    m = C.Matcher([(i, [n], None) for i, n in enumerate(names)], False)
    text = list(data.draw(st.sampled_from(names)))
    for _ in range(data.draw(st.integers(0, 3))):
        i = data.draw(st.integers(0, len(text) - 1))
        text[i : i + data.draw(st.integers(0, 1))] = data.draw(st.sampled_from(["", "x", "a", "r"]))
        text = text or ["a"]
    full = C.stripped("".join(text))
    tokens = tuple(w for w in C.words(full) if w not in C.STOP)
    if tokens:
        assert {k for k, v in enumerate(m.variants) if m.fits(full, list(tokens), v)} <= m.candidates(full, tokens)


def test_additions_are_learnt_from_the_values(spark):
    ref = spark.createDataFrame([(i, "faculty", f"Faculty of {x}", None, None, 9) for i, x in enumerate(("Arts", "Law", "Economics", "Chemistry"), 1)], "ref_id int, kind string, canonical_name string, alt_name string, short_code string, value int")
    house = ", Elbonian State College"
    told = [f"Faculty of {x}{house}" for x in ("Arts", "Law", "Economics")]
    values = spark.createDataFrame([("faculty", v, 1) for v in [*told, f"Fac. of Chemistry{house}", "Faculty of Law in Space", "Faculty of Arts and Law"]], "kind string, value string, ref_id int")
    got = {r.value: r.ref_id for r in C.map_to_reference(values, ref).collect()}
    assert [got[t] for t in told] == [1, 2, 3] and got[f"Fac. of Chemistry{house}"] == 4
    assert got["Faculty of Law in Space"] == 0 and got["Faculty of Arts and Law"] == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12), st.integers(40, 60))
def test_every_item_is_held_once_and_nothing_overflows(counts, capacity):
    uses = P.solve(counts, capacity)
    held = Counter()
    for u in uses:
        assert sum(l * a for l, a in u.pattern.items()) <= capacity and u.times > 0
        for l, a in u.pattern.items():
            held[l] += a * u.times
    assert held == Counter(counts)
    assert sum(u.times for u in uses) <= sum(u.times for u in P.fill_rest(counts, capacity))


def test_the_program_itself_is_returned():
    needs = lambda uses: sum(u.times for u in uses)
    tie = {5: 7, 4: 9, 3: 2}
    assert needs(P.solve(tie, 10)) == needs(P.fill_rest(tie, 10)) and P.solve(tie, 10) != P.fill_rest(tie, 10)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.tuples(st.integers(1, 4), st.floats(0.1, 9)), min_size=1, max_size=4), st.integers(5, 30))
def test_pricing_against_brute_force(items, capacity):
    lengths = list(items)

    def best(i, room):
        if i == len(lengths):
            return 0.0
        l = lengths[i]
        return max(k * items[l][1] + best(i + 1, room - k * l) for k in range(min(items[l][0], room // l) + 1))

    got = P.price({l: v for l, (_, v) in items.items()}, {l: n for l, (n, _) in items.items()}, capacity)
    assert all(got[l] <= items[l][0] for l in got) and sum(l * a for l, a in got.items()) <= capacity
    assert sum(a * items[l][1] for l, a in got.items()) == pytest.approx(best(0, capacity))


DOCS = [(i, " ".join(["word"] * n), s) for i, (n, s) in enumerate([(0, "a"), (3, "a"), (700, "b"), (120, "a"), (45, None), (260, "b"), (31, "a"), (31, "c"), (5000, "b")] * 3)] + [(1, None, "a")]


def documents(spark):
    return spark.createDataFrame([(*d, 9) for d in DOCS], "doc_id bigint, text string, source string, n_tokens int")


def test_sizes(spark):
    enc = tokens.encoding(tokens.DEFAULT_VOCABULARY)
    got = sorted((r.doc_id, r.n_tokens) for r in tokens.token_sizes(documents(spark)).collect())
    assert got == sorted((i, len(enc.encode_ordinary(t)) if t else 0) for i, t, _ in DOCS)


def test_packing(spark):
    caps = spark.createDataFrame([(1, 128), (2, 512), (3, None), (4, 0)], "capacity_id int, capacity_tokens int")
    size = Counter()
    enc = tokens.encoding(tokens.DEFAULT_VOCABULARY)
    for i, t, _ in DOCS:
        size[i] += len(enc.encode_ordinary(t)) if t else 0
    out = P.pack(documents(spark), caps).collect()
    for cap, capacity in ((1, 128), (2, 512)):
        mine = [r for r in out if r.capacity_id == cap]
        by, docs = Counter(), Counter()
        for r in mine:
            by[r.container_id] += r.n_tokens
            docs[r.doc_id] += r.n_tokens
        assert max(by.values()) <= capacity and sorted(by) == list(range(len(by)))
        assert docs == size or {k: v for k, v in docs.items() if v} == {k: v for k, v in size.items() if v}
        pieces = Counter(r.doc_id for r in mine)
        for i, t, _ in DOCS:
            n = len(enc.encode_ordinary(t)) if t else 0
            if i != 1:
                assert pieces[i] == max(1, math.ceil(n / capacity))
    assert {r.capacity_id for r in out} == {1, 2}
    report = {r.capacity_id: r for r in P.fill_report(P.pack(documents(spark), caps), caps).collect()}
    assert report[2].n_containers >= report[2].least_containers
    assert all(r.by_program + r.by_pricing + r.by_first_fit == r.n_containers for r in report.values()) and report[1].by_program + report[1].by_pricing > 0
    assert P.pack(documents(spark).limit(0), caps).count() == 0 and P.pack(documents(spark), caps.limit(0)).count() == 0


def test_too_long_lists_are_refused(spark, monkeypatch):
    caps = spark.createDataFrame([(i, 100 + i) for i in range(5)], "capacity_id int, capacity_tokens int")
    targets = spark.createDataFrame([(f"s{i}", 0.2, 1) for i in range(5)], "source string, target_share double, max_repeats int")
    df = spark.createDataFrame([(i, f"text of {i}", f"s{i}") for i in range(9)], "doc_id bigint, text string, source string")
    assert {r.source for r in X.mix(df, targets).collect()} == {f"s{i}" for i in range(5)}
    monkeypatch.setattr(P, "MAX_CAPACITIES", 4)
    monkeypatch.setattr(X, "MAX_SOURCES", 5)  # more sources than that, but no more targets
    assert {r.source for r in X.mix(df, targets).collect()} == {f"s{i}" for i in range(5)}
    monkeypatch.setattr(X, "MAX_SOURCES", 4)
    for call in (lambda: P.pack(df, caps), lambda: X.mix(df, targets)):
        with pytest.raises(ValueError):
            call()


def test_ranks_are_dense_with_a_hot_length(spark):
    df = spark.range(5000).selectExpr("1 as k", "id % 700 as doc_id", "0 as piece_no")
    got = sorted(r["rank"] for r in P._ranked(df, ["k"], ["doc_id", "piece_no"]).collect())
    assert got == list(range(5000))


def test_schedule_sums_to_one_and_means_the_share():
    shares, natural = {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 0.8, "b": 0.1, "c": 0.1}
    w = X.schedule(shares, natural, 1.0)
    for t in np.linspace(0, 1, 5):
        assert sum(f + (l - f) * t for f, l in w.values()) == pytest.approx(1)
    for s, (f, l) in w.items():
        assert (f + l) / 2 == pytest.approx(shares[s]) and min(f, l) >= -1e-9


def test_mixture(spark):
    rows = [(i, "word " * (20 + i % 7), "abc"[0 if i < 400 else 1 if i < 480 else 2], 1) for i in range(600)] + [(900, "x", None, 1), (901, "", "a", 1), (902, None, "b", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, position int")
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.4, 3), ("c", 0.2, 2), ("gone", 0.3, 2), ("d", None, 1)], "source string, target_share double, max_repeats int")
    out = X.mix(df, targets).collect()
    total = sum(r.n_tokens for r in out)
    use = Counter((r.source, r.doc_id) for r in out)
    for s, share, cap in (("a", 0.4, 1), ("b", 0.4, 3), ("c", 0.2, 2)):
        assert sum(r.n_tokens for r in out if r.source == s) / total == pytest.approx(share, abs=0.01)
        assert max(n for (q, _), n in use.items() if q == s) <= cap
    assert len(set((r.doc_id, r.repeat_no) for r in out)) == len(out)
    assert [r.position for r in out] == sorted(r.position for r in out)
    late = [r for r in out if r.source == "b"]
    assert sum(r.position > total / 2 for r in late) > len(late) / 2  # the rare source's weight rises
    report = {r.source: r for r in X.share_report(X.mix(df, targets), targets).collect()}
    assert report["gone"].tokens == 0 and report["b"].repeats_used == 3
    assert X.mix(df.limit(0), targets).count() == 0 and X.mix(df, targets.limit(0)).count() == 0
