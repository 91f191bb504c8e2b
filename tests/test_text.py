"""Text functions."""

from __future__ import annotations

import unicodedata

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import text as X
from scriptorium.functions.similarity import jaro_winkler, may_reach


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("value", "fixed", "kind"),
    [
        ("Ã©test", "étest", "mojibake"), ("  hello  ", "hello", "trailing_spaces"), ("hello world", "hello world", "nbsp"), ("hello  world", "hello world", "double_space"), ("Venˇec", "Venec", "standalone_diacritics"),
        ("Lapı", "Lapí", "encoding_chars"), ("Ĝeho", "řeho", "encoding_chars"), ("igure", "ftigure", "encoding_chars"), ("a௅b", "a–b", "encoding_chars"),
    ],
)
def test_fixes(spark, value, fixed, kind):
    assert one(spark, value, lambda c: X.text_fixes(c)[0]) == fixed
    assert one(spark, value, lambda c: dict(X.text_fixes(c)[1])[kind])


def test_mojibake(spark):
    damaged = "Možnosti – fólií “x” 漢字 😀".encode().decode("latin-1")
    western = "".join(bytes([b]).decode("cp1252", "replace").replace("\ufffd", chr(b)) for b in "Možnosti – “x”".encode())
    assert one(spark, damaged, X.fix_mojibake) == "Možnosti – fólií “x” 漢字 😀"
    assert one(spark, western, X.fix_mojibake) == "Možnosti – “x”"
    long = "a" * 100_000
    assert one(spark, long + "Ã©", X.fix_mojibake) == long + "é"
    for v in ("Možnosti", "é", "Ã©Ã", "Ã©©", "â\x80", "Ã© ž", "\xed\xa0\x80", "plain", "", None):
        assert one(spark, v, X.fix_mojibake) == v


def test_normal_text_stays(spark):
    for v in ("Normálny text", "https://example.com/?via%3Dihub"):
        assert one(spark, v, lambda c: X.text_fixes(c)[0]) == v


def test_accents_equal_decomposition(spark):
    text = "Příliš žluťoučký kůň Ľubomír Ångström Ñandú ệ Ё ΐ ﬁ Łódź ø"
    want = "".join(ch for ch in unicodedata.normalize("NFD", text) if unicodedata.category(ch) != "Mn")
    assert one(spark, text, X.strip_accents) == want
    assert one(spark, unicodedata.normalize("NFD", text), X.strip_accents) == want


@pytest.mark.parametrize(("value", "out"), [("https://doi.org/10.1234/x", "10.1234/x"), ("10.1016/j.foo.2020?via%3Dihub", "10.1016/j.foo.2020"), ("DOI:10.1/ab/", "10.1/ab"), (" 10.1234/x#top", "10.1234/x")])
def test_doi(spark, value, out):
    assert one(spark, value, X.clean_doi) == out


def test_identifiers(spark):
    assert one(spark, ["0001-6373,1588-2659", "bad", "1588-2659"], X.parse_issns, "array<string>") == ["0001-6373", "1588-2659"]
    assert one(spark, ["978-0-306-40615-7", "123456789X", "12"], X.parse_isbns, "array<string>") == ["9780306406157", "123456789X"]
    assert one(spark, "1234-567X", X.issn_form) == "1234567x"
    assert [one(spark, v, X.year_of) for v in ("2018-06-15", "Published in 2019", "no year here", None)] == [2018, 2019, None, None]


def test_forms(spark):
    assert one(spark, "Schrödinger", X.normalise) == "schrodinger"
    assert one(spark, None, X.normalise) == ""
    assert one(spark, ["10.1234/ABC ", "other"], X.value_form, "array<string>") == "10.1234/abc"
    assert one(spark, [], X.value_form, "array<string>") is None
    assert one(spark, "a b", X.title_keys) == ["p16:a b", "p24:a b", "f2:a b", "l2:a b"]
    merged = spark.createDataFrame([(["Novák", "b"], ["novak", "C", ""])], "l array<string>, r array<string>").select(X.merge_ordered(F.col("l"), F.col("r")).alias("y")).first()["y"]
    assert merged == ["Novák", "b", "C"]


def test_jaro_winkler():
    assert jaro_winkler("", "a") == 0.0
    assert jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert jaro_winkler("dixon", "dicksonx") == pytest.approx(0.8133, abs=1e-4)


def test_filter_before_similarity_loses_nothing(spark):
    words = ["polymer", "polymers", "polygon", "monomer", "a", "ab", "abcdefghij", "abcdefgh", "xbcdefgh", "polymr"]
    for t in (0.85, 0.96):
        df = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
        kept = {(r.a, r.b) for r in df.filter(may_reach(F.col("a"), F.col("b"), t)).collect()}
        assert {(a, b) for a in words for b in words if jaro_winkler(a, b) >= t} <= kept
