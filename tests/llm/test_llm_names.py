"""Variant spellings of names."""

from __future__ import annotations

import pytest
from hypothesis import given, settings, strategies as st

from scriptorium.llm import names as N

REGISTRY = "author_id bigint, display_name string, other_name string, surname string, given_name string, middle_name string, name string"


def registry(spark, *rows):
    return spark.createDataFrame([(*r, *[None] * (6 - len(r)), "clash") for r in rows], REGISTRY)


PEOPLE = [
    (1, "Skevorbíková, Olga"), (2, "Chilovský, Eduard||Chilovsky E"), (3, "Ing. Vladimír Douvolkoch, CSc.", "Douvolkoch, Láďa; Zdilavel, Vladimír"), (4, "Krynek, Jan"), (5, "Krynek, Jana"),
    (6, "Šuzáková, Markéta"), (6, "Šuzáková, Markéta"), (7, None, None, "Žouhulová", "Petra"),
]


@pytest.mark.parametrize(
    ("name", "author"),
    [
        ("Skevorbikova, Olga", 1), ("Olga Skevorbíková", 1), ("SKEVORBÍKOVÁ Olga", 1), ("O.Skevorbíková", 1), ("Skevorbíková O", 1), ("Skevorbíková. Olga", 1), ("Skevorbíkvoá, Olga", 1), ("Skevorbíková, Ogla", 1),
        ("doc. Ing. Chilovský Eduard, Ph.D.", 2), ("Eda Chilovský", 2), ("Chilovský, Edu.", 2), ("Chilovsky, Eduard Z.", 2), ("Zdilavel, Vladimír", 3), ("Douvolkoch, Vladimírr", 3),
        ("Krynek, Jan", 4), ("Krynek, J.", None), ("Krynek, Janaa", 5), ("Nobody, Olga", None), ("Suzhakova, Marketa", 6), ("Žouhulová; Petra", 7), ("Ž?uhulová, Petra", 7), ("Olga", None), ("", None), (None, None),
    ],
)
def test_link(spark, name, author):
    df = spark.createDataFrame([(name, 1), (name, 2)], "name string, author_id int")
    got = [r.author_id for r in N.link_names(df, registry(spark, *PEOPLE)).collect()]
    assert got == ([author] if author else [])


def test_query(spark, records):
    df = records({"resource_id": 1, "dc_contributor_author": ["Olga Skevorbíková", None, "Skevorbíková, Olga", "Stranger, Ann", "", "x" * 20_000]}, {"resource_id": 2})
    got = [tuple(r) for r in N.p1_found(df, registry(spark, *PEOPLE)).collect()]
    assert got == [(1, 1, 1)]
    assert N.p1_found(df.limit(0), registry(spark, *PEOPLE)).count() == 0
    assert N.p1_found(df, registry(spark, *PEOPLE).limit(0)).count() == 0


def one_edit(a: str, b: str) -> bool:
    """Whether at most one insertion, deletion, substitution or swap of neighbours leads from a to b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) < len(b):
        return a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or (i + 1 < len(a) and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abc ", min_size=5, max_size=9), st.data())
def test_one_edit_always_meets(text, data):
    i = data.draw(st.integers(0, len(text) - 1))
    other = data.draw(st.sampled_from([text[:i] + text[i + 1 :], text[:i] + "z" + text[i:], text[:i] + "z" + text[i + 1 :], text[:i] + text[i + 1 : i + 2] + text[i] + text[i + 2 :]]))
    assert one_edit(text, other)
    assert (N._drops(text) | {text}) & (N._drops(other) | {other})


def test_one_edit_is_no_more():
    assert not one_edit("novak jan", "novik jon") and not one_edit("ab", "ba c")


def test_native_check_equals_one_edit(spark):
    from pyspark.sql import functions as F

    words = ["abcd", "abdc", "acbd", "badc", "cbad", "abc", "abcde", "abxd", "dbca", "ab", "abcd"]
    df = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    lev = F.levenshtein("a", "b", 2)
    ok = lev.isin(0, 1) | ((lev == 2) & (F.length("a") == F.length("b")) & N._is_swap(F.col("a"), F.col("b")))
    assert all(r.ok == one_edit(r.a, r.b) for r in df.select("a", "b", ok.alias("ok")).collect())


def people(spark, *names):
    return spark.createDataFrame([(i, n, None, None, None, None) for i, n in enumerate(names, 1)], "author_id bigint, display_name string, other_name string, surname string, given_name string, middle_name string")


def linked(spark, typed, registry):
    return {r.name: r.author_id for r in N.link_names(spark.createDataFrame([(t, 0) for t in typed], "name string, author_id int"), registry).collect()}


def test_short_names_with_an_error(spark):
    registry = people(spark, "Ha, Eva", "Novák, Jan", "Dlouhý, Petr", "Ós, Ivo")
    assert linked(spark, ["Hla, Eva", "Ha Evva", "Ha, Iva", "Ós, Ivvo", "Xx, Yyy"], registry) == {"Hla, Eva": 1, "Ha Evva": 1, "Ha, Iva": 1, "Ós, Ivvo": 4}


def test_legal_forms_of_organisations(spark):
    registry = people(spark, "Borovice Plastics, s.r.o.", "Alfa Rubber Ltd.", "Novák, Jan", "Sa, Maria")
    typed = ["BOROVICE PLASTICS spol. s r. o.", "Plastics Borovice GmbH", "Alfa & Rubber Limited", "Alfa Rubber Inc", "The Alfa Rubber Corp.", "Maria Sa", "Beta Rubber Ltd", "s.r.o."]
    assert linked(spark, typed, registry) == {**dict.fromkeys(typed[:2], 1), **dict.fromkeys(typed[2:5], 2), "Maria Sa": 4}
    assert N.organisation("Novák, a.s.") == "novak" and N.organisation("Novák as") is None and N.organisation("Ltd") is None


def test_settled_names_need_no_dropped_letters(spark):
    """The result is the same whether dropped letters are written for all names or only for those left open."""
    registry = people(spark, "Novák, Jan", "Novák, Jana", "Horák, Petr", "Dvořák, Karel", "Dvořáková, Karla")
    typed = ["Novak Jan", "J. Novák", "Jan Novk", "Petr Horak", "Hork, Petr", "Dvorak K.", "Karel Dvořk", "Jana Novák"]
    got = linked(spark, typed, registry)
    assert got == {"Novak Jan": 1, "Jan Novk": 1, "Petr Horak": 3, "Hork, Petr": 3, "Dvorak K.": 4, "Karel Dvořk": 4, "Jana Novák": 2}
    for t in typed:
        every = dict((f, h) for f, h, _ in N.forms(t, False))
        parts = {f: h for d in (False, True) for f, h, _ in N.forms(t, False, None, d)}
        assert every == parts
