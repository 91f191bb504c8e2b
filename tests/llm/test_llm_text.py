"""Wrong encodings, look-alikes, repetition."""

from __future__ import annotations

import html.entities
import unicodedata
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from scriptorium.llm import lookalikes as L, mojibake as M, repetition as R

CORPUS = ["Možnosti obalových fólií", "Hodnocení mléčných výrobků", "Vliv účetních závěrek na směsi", "Přístupy zařízení škol žáků", "Über städtische Prozesse", "On tax – the case", "“Good enough” colour", "Role of α-amylase", "Анализ свойств плёнок", "Drotzøye, Inês Barrarrèle", "Jiří Šimon Ľubomír Dvořák", "toků uzlů dílů trhů služby"] * 30


@pytest.fixture(scope="module")
def plausible():
    counts = np.zeros(M.BUCKETS, dtype=np.int64)
    for g, n in Counter(g for t in CORPUS for g in M.trigrams(t)).items():
        counts[M.bucket(g)] += n
    return M.Plausibility(counts)


def misread(text, true, wrong):
    table = {b: ch for ch, b in M._bytes_of(wrong).items()}
    return "".join(table[b] for b in text.encode(true))


@pytest.mark.parametrize("wrong", ["cp1252", "latin-1", "cp1250", "mac_roman", "cp852"])
@pytest.mark.parametrize("text", sorted(set(CORPUS)))
def test_round_trip(plausible, wrong, text):
    assert plausible.repair(misread(text, "utf-8", wrong)) == text


@pytest.mark.parametrize("text", ["Možnosti obalových fólií", "Vliv účetních závěrek na směsi", "Přístupy zařízení škol žáků"])
def test_other_errors(plausible, text):
    assert plausible.repair(misread(misread(text, "utf-8", "cp1252"), "utf-8", "cp1252")) == text
    assert plausible.repair(misread(text, "iso8859_2", "cp1252")) == text
    assert plausible.repair(misread(text, "utf-8", "cp1252").split(" ")[0] + " fólií") == text.split(" ")[0] + " fólií"


@pytest.mark.parametrize("text", sorted(set(CORPUS)))
def test_entities_and_escapes(plausible, text):
    numbers = "".join(f"&#{ord(c)};" if c > "\x7f" else c for c in text)
    names = "".join(f"&{html.entities.codepoint2name[ord(c)]};" if c > "\x7f" and ord(c) in html.entities.codepoint2name else c for c in text)
    escapes = "".join(f"\\u{ord(c):04x}" if c > "\x7f" else c for c in text)
    for damaged in (numbers, names, escapes, numbers.replace("&", "&amp;"), names[: len(names) // 2] + names[len(names) // 2 :].replace("á", "\\u00e1")):
        assert plausible.repair(damaged) == text


def every_text(plausible, chunk):
    """Cheapest text by trying all paths, as brute force."""
    best, todo, paid = (plausible(chunk), chunk), [(chunk, 0.0, 0)], {(chunk, 0): 0.0}
    while todo:
        text, cost, reread = todo.pop()
        best = min(best, (plausible(text) + cost, text))
        for after, price, single in M.steps(text):
            state = after, reread + single
            if state[1] <= M.SINGLE_BYTE_STEPS and cost + price < paid.get(state, best[0] + 1e-9):
                paid[state] = cost + price
                todo.append((after, cost + price, state[1]))
    return best[0]


@pytest.mark.parametrize("text", ["Možnosti", "účetních", "zařízení", "Přístupy", "Über", "плёнок"])
def test_the_search_finds_the_cheapest_text(plausible, text):
    """Against brute force over all paths; nothing is cut after a number of states."""
    once = misread(text, "utf-8", "cp1252")
    for damaged in (text, once, misread(once, "utf-8", "cp1252"), misread(once, "utf-8", "cp1250"), *([misread(text, "iso8859_2", "cp1252")] if text[0] != "п" else [])):
        found = plausible.restore(damaged)
        assert plausible(found) <= every_text(plausible, damaged) + 1e-9


def test_long_damage_is_searched_whole(plausible):
    text = "účetních" * 300
    assert plausible.repair(misread(misread(text, "utf-8", "cp1252"), "utf-8", "cp1252")) == text
    assert plausible.repair("\ufffd" * 2000 + "Ã" * 2000)  # ends


def test_entities_mixed_with_misreading(plausible):
    assert plausible.repair("Dvo&Aring;&#153;&aacute;k") == "Dvořák" and plausible.repair("AT&amp;T x &lt; y; R&D; &nosuch; \\u0000 \\ud800 a&b") == "AT&T x < y; R&D; &nosuch; \\u0000 \\ud800 a&b"
    assert plausible.repair("\\ud835\\udc00") == "\U0001d400"


def test_good_text_stays(plausible):
    for t in [*CORPUS, "plain", "embedded\xa0hydrogel foams at 62 °C", "hyphe\xadn", "a?b", ""]:
        assert plausible.repair(t) == t


def test_lost():
    assert M.is_lost("ml��ných", False) and M.is_lost("V?cevrstvé vlastnosti", False) and M.is_lost("Ond?ej", True) and M.is_lost("digitáln? obce", False)
    assert not M.is_lost("Does it change? Evidence from x", False)


def test_query(records):
    df = records({"resource_id": 1, "dc_title": [misread("Možnosti obalových fólií", "utf-8", "cp1252"), None, "Možnosti obalových fólií"], "dc_contributor_author": ["Ond?ej", ""]}, {"resource_id": 2}, *[{"resource_id": 10 + i, "dc_title": t} for i, t in enumerate(CORPUS)])
    assert sorted(tuple(r) for r in M.p4_found(df).collect()) == [(1, "dc_contributor_author", 1), (1, "dc_title", 1)]
    assert M.p4_found(df.limit(0)).count() == 0


FORMS = {"Ｆｕｌｌ width": "Full width", "a b c": "a b c", "soft­hyphen​": "softhyphen", "co‐op ﬁne": "co-op fine", "Rοle οf x": "Role of x", "Тhermische": "Thermische", "vерejný": "vepejný", "s а t": "s a t", "é̌ ů": unicodedata.normalize("NFC", "é̌ ů"), "Å": "Å"}


def elements(spark, texts):
    return spark.createDataFrame([(i, "f", 1, t, "clash") for i, t in enumerate(texts)], "row_id bigint, field_name string, value_pos int, text string, part_text string")


def test_unify(spark):
    got = {r.row_id: r.unified for r in L.unify_text(elements(spark, FORMS)).collect()}
    assert [got[i] for i in range(len(FORMS))] == list(FORMS.values())


def test_ordinary_text_stays(spark):
    texts = ["Výběr – “x” 5 °C", "β-glucan α x", "Анализ свойств", "Методика ABC текст", "", None, "plain\ttext\n"]
    assert L.unify_text(elements(spark, texts)).count() == 0 and L.unify_text(elements(spark, texts).limit(0)).count() == 0


def test_canonical_order_against_the_library(spark):
    texts = ["ạ̇b", "ạ̇b", "ộ", "ṩ̣", "q̣̇", "Ǻ", "x" * 30_000 + "é"]
    got = {r.row_id: r.unified for r in L.unify_text(elements(spark, texts)).collect()}
    assert {i: unicodedata.normalize("NFC", t) for i, t in enumerate(texts) if unicodedata.normalize("NFC", t) != t} == got


def test_korean_letters_and_all_planes(spark):
    jamo = unicodedata.normalize("NFD", "한국어 강 값이 가")
    texts = [jamo, "\u1100\u1161\u11a8\u11a8 a\u1161 \u1161\u11a8 \uac01\u11a8", "tag\U000e0041ged", "select\U000e0101or", "\U0002f800", "Ꭺbstract հouse", "한국어 값", "\U0001f600 a\u00a0b \U00020000\U0001d400\U0001d41b"]
    got = {r.row_id: r.unified for r in L.unify_text(elements(spark, texts)).collect()}
    expected = {0: unicodedata.normalize("NFC", jamo), 1: unicodedata.normalize("NFC", texts[1]), 2: "tagged", 3: "selector", 4: unicodedata.normalize("NFC", "\U0002f800"), 5: "Abstract house", 7: "\U0001f600 a b \U00020000Ab"}
    assert got == expected


def test_p5(records):
    df = records({"resource_id": 1, "dc_title": ["a b", "plain"], "utb_scopus_affiliation": ["Тown x"], "dc_description_abstract": None}, {"resource_id": 2}, {"resource_id": 1, "dc_title": ["a b", "plain"]})
    assert sorted(tuple(r) for r in L.p5_found(df).collect()) == [(1, "dc_title", 1), (1, "utb_scopus_affiliation", 1)]
    assert L.p5_found(df.limit(0)).count() == 0


def brute(words, run=8):
    seen, marked = set(), [False] * len(words)
    for i in range(len(words) - run + 1):
        g = tuple(words[i : i + run])
        if g in seen:
            marked[i : i + run] = [True] * run
        seen.add(g)
    return marked


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=60))
def test_repeated_words_against_brute_force(words):
    assert R.repeated_words(words).tolist() == brute(words)


def test_lines_and_labels():
    phrase = "this phrase is said again and again without end"
    doc = R.read_document(f"{phrase}. Fresh words stand here, none of them old. {phrase.upper()}!\n12 go go go")
    features, labels = R.line_features(doc), R.line_labels(doc)
    assert len(doc.words) == 29 and doc.starts.tolist() == [0, 8, 9, 17, 25, 26]
    assert labels.tolist() == [0, 0, 0, 1, 1, 0] and features[3, 1] == 0.875 and features[3, 3] == 1
    assert R.line_features(R.read_document(None)).shape == (0, R.FEATURES)


def test_field_learns_and_decodes():
    again = [1, 0.95, 1, 1, 1, 0]
    fresh = [1, 0.0, 0, 0, 1, 0]
    features = np.array([[fresh] * 5 + [again] * 5] * 20, dtype=float)
    field = R.train(features, (features[..., 2] > 0).astype(int), np.ones(features.shape[:2]))
    assert R.decode(field, features[0]).tolist() == [0] * 5 + [1] * 5
    assert R.decode(field, np.zeros((0, R.FEATURES))).tolist() == []


def test_the_chain_decides():
    """A doubtful line is repetition among such lines and content among others; without transitions it is the same in both."""
    w = np.zeros((R.FEATURES, 2))
    w[0, 1], w[1, 1] = -2.0, 4.0
    chain, single = R.Field(w, np.array([[1.0, -1.0], [-1.0, 1.0]])), R.Field(w, np.zeros((2, 2)))
    line = lambda share: [1, share, 0, 0, 1, 0]
    old, new = np.array([line(1), line(0.4), line(1)]), np.array([line(0), line(0.4), line(0)])
    assert R.decode(chain, old).tolist() == [1, 1, 1] and R.decode(chain, new).tolist() == [0, 0, 0]
    assert R.decode(single, old).tolist() == [1, 0, 1]


def test_retention_follows_the_content_share(spark, monkeypatch):
    phrase = "this phrase is said again and again without any end or reason. "
    fresh = " ".join("abcdefghijklmnopqrstuvwxyz"[i % 26] * (2 + i // 26) for i in range(100))
    df = spark.createDataFrame([(i, phrase * 5 if i % 10 == 7 else fresh) for i in range(100)] + [(200, None), (201, "")], "doc_id bigint, text string")
    gone = {r.doc_id for r in R.retention(df).filter("not retained").collect()}
    assert gone == {i for i in range(100) if i % 10 == 7} == {r.doc_id for r in R.p10_found(df).collect()}
    monkeypatch.setattr(R, "fit", lambda *a: R.Field(np.array([[0, -50.0], *[[0, 0]] * (R.FEATURES - 1)]), np.zeros((2, 2))))
    assert R.p10_found(df).count() == 0 and R.retention(df).filter("not retained").count() == 0


def test_p10(spark):
    phrase = "this phrase is said again and again without any end or reason"
    fresh = " ".join("abcdefghijklmnopqrstuvwxyz"[i % 26] * (2 + i // 26) for i in range(100))
    texts = [phrase + ". " + phrase.upper() + "! " + phrase, fresh, fresh + ". " + phrase + ". " + phrase, None, "", "12 34", (phrase + ".\n") * 3000, "one two three four 5 five six seven eight. One, two three-four five six 7 seven eight"]
    rows = [(i, t, 0.0) for i, t in enumerate(texts)] + [(0, texts[0], 0.0)] + [(100 + i, fresh + str(i), 0.0) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, content_share double")
    assert sorted(r.doc_id for r in R.p10_found(df).collect()) == [0, 6, 7]
    assert R.p10_found(df.limit(0)).count() == 0


def test_spoilt_texts_outside_the_sample_are_found(spark):
    phrase = "this phrase is said again and again without any end or reason. "
    fresh = " ".join("abcdefghijklmnopqrstuvwxyz"[i % 26] * (2 + i // 26) for i in range(100))
    rows = [(i, phrase * 5 if i % 100 == 7 else fresh) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    expected = {i for i in range(1000) if i % 100 == 7}
    for docs in (3, 20, 80, 800):
        got = R.repetition(df, field=R.fit(df, train_docs=docs)).filter(f"content_share <= {R.CONTENT_AT_MOST} and repeated_share >= 0.3")
        assert {r.doc_id for r in got.collect()} == expected
    assert {r.doc_id for r in R.p10_found(df).collect()} == expected
