"""Free-entered values mapped to the closest entry of a reference list.

Plan: values are made distinct first, so that each is matched once however often it occurs. What people add behind the
entries of the list (the name of the house, say) is learnt from the values: tails that follow many different entries. An
Arrow pass retrieves candidates from an inverted index: the words of the list that share a character trigram with a word,
and from them the entries that have such words in their places, or a part of the whole; no candidate that could pass is
left out. They are scored by weighted cosine and accepted above a threshold and a margin, with an exact word-by-word check.
The result is joined back on the value; a hot value is one row on the matched side, and adaptive execution splits it on
the other.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

THRESHOLD, MARGIN = 0.4, 0.01
#: A tail is an addition if it follows at least so many different entries, and this share of a kind's entries.
TAIL_ENTRIES, TAIL_SHARE = 3, 0.05
MAX_TAIL_WORDS, MAX_TAILS = 8, 10_000
#: Largest reference list that is held by every task; a longer one is refused (it wouldn't be a list of canonical names).
MAX_REFERENCE = 100_000

# Words without weight; heads that may be left out; usual contractions that are no prefixes; forms of additions.
STOP = frozenset("of in and for on the a an to at v ve na".split())
HEADS = frozenset("faculty department institute centre studio laboratory fakulta ustav centrum atelier laborator".split())
CONTRACTIONS = {"dept": "department", "dpt": "department", "ctr": "centre", "center": "centre", "jnl": "journal", "jrnl": "journal", "intl": "international", "natl": "national", "univ": "university"}
ADDITIONS = (
    r"[\(\[][^\)\]]*[\)\]]\s*$", r"\s:\s.*$", r",?\s*vol\.?\s*\d+\s*$",
)

_ADDITIONS = [re.compile(p) for p in ADDITIONS]
_INVERTED = re.compile(r"^(.*\S)\s*,\s*(\w+ (?:of|for|in|on))\s*$")


def plain(text: str) -> str:
    """Lower case without accents, compatibility forms or doubled blanks."""
    text = unicodedata.normalize("NFKD", text).lower()
    text = "".join(ch for ch in text if not unicodedata.combining(ch) and unicodedata.category(ch) != "Cf")
    return " ".join(text.replace("&", " and ").split())


def stripped(text: str, tails: frozenset[str] = frozenset()) -> str:
    """Plain text without additions (usual forms, and those of ``tails``), an inverted head put first."""
    text = plain(text).strip(" .,;:")
    before = None
    while text != before:
        before = text
        for p in _ADDITIONS:
            text = p.sub("", text).strip(" ,;:") or text
        for head, tail in heads_and_tails(text) if tails else ():
            if tail in tails:
                text = head
                break
    if m := _INVERTED.match(text):
        text = f"{m[2]} {m[1]}"
    return text


def heads_and_tails(text: str) -> list[tuple[str, str]]:
    """Every division of a plain text into a beginning and at most ``MAX_TAIL_WORDS`` words behind it, longest tail first."""
    starts = [m.start() for m in re.finditer(r"\S+", text)][1:][-MAX_TAIL_WORDS:]
    return [(text[:i].strip(" ,;:-"), text[i:].strip(" ,;:-")) for i in starts]


def words(text: str) -> list[str]:
    """Words with weight of a stripped text, contractions spelt out."""
    return [CONTRACTIONS.get(w, w) for w in re.findall(r"[^\W_]+", text)]


class Variant(NamedTuple):
    """One way to write an entry. ``parts`` divide it so that one of them outlasts any two edits."""

    ref_id: int
    full: str
    words: tuple[str, ...]
    parts: tuple[str, ...]


def divided(text: str, most: int) -> tuple[str, ...]:
    """``text`` in so many equal parts that ``most`` edits, each of which touches two at most, leave one as it is."""
    n = 2 * most + 1
    return tuple(text[len(text) * k // n : len(text) * (k + 1) // n] for k in range(n))


def near(a: str, b: str, most: int) -> bool:
    """Whether at most ``most`` insertions, deletions, substitutions or swaps of neighbours lead from a to b."""
    if abs(len(a) - len(b)) > most:
        return False
    if a == b:
        return True
    n, i, j = min(len(a), len(b)), 0, 0
    while i < n and a[i] == b[i]:
        i += 1
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]  # what differs
    if max(len(a), len(b)) <= most:
        return True
    if most < 2:
        return most == 1 and len(a) == len(b) == 2 and a == b[::-1]
    if len(set(a) ^ set(b)) > 2 * most:  # an edit brings one character and takes one
        return False
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            best = min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            now.append(best)
        if min(now) > most:
            return False
        before, row = row, now
    return row[-1] <= most


def word_fits(a: str, b: str) -> bool:
    """Whether a word equals or abbreviates one of the list, or is a typing error away from it."""
    return b.startswith(a) or len(b) > 3 and near(a, b, 1 if len(b) < 9 else 2)


def grams(tokens: tuple[str, ...] | list[str]) -> list[str]:
    """Character trigrams of words, the beginnings of words marked."""
    out = []
    for w in tokens:
        padded = f"^{w}$"
        out.append(padded[:2])
        out += [padded[i : i + 3] for i in range(len(padded) - 2)]
    return out


class Matcher:
    """Inverted index over one kind of entries."""

    def __init__(self, entries: list[tuple[int, list[str | None], str | None]], drop_heads: bool, tails: frozenset[str] = frozenset()) -> None:
        self.tails = tails
        self.codes: dict[str, int] = {}
        seen: dict[tuple[int, tuple[str, ...]], Variant] = {}
        for ref_id, names, code in entries:
            if code and code.strip():
                self.codes[re.sub(r"[^a-z0-9]", "", plain(code))] = ref_id
            for name in names:
                if not name or not name.strip():
                    continue
                full = stripped(name)  # an entry is written as it is meant
                tokens = tuple(w for w in words(full) if w not in STOP)
                for t in {tokens, tokens[1:] if drop_heads and tokens[0] in HEADS and len(tokens) > 1 else tokens}:
                    whole = full if t == tokens else " ".join(t)
                    seen.setdefault((ref_id, t), Variant(ref_id, whole, t, divided(whole, 2)))
        self.variants = list(seen.values())
        self.words_with: dict[str, set[str]] = defaultdict(set)  # trigram to words of the list
        self.at: dict[tuple[int, int, str], set[int]] = defaultdict(set)  # number of words, place and word to variants
        self.pieces: dict[tuple[int, int, str], set[int]] = defaultdict(set)  # length, place and part to variants
        counts: Counter[str] = Counter()
        for k, v in enumerate(self.variants):
            counts.update(set(grams(v.words)))
            for i, w in enumerate(v.words):
                self.at[len(v.words), i, w].add(k)
                for g in grams([w]):
                    self.words_with[g].add(w)
            for i, part in enumerate(v.parts):
                self.pieces[len(v.full), i, part].add(k)
        n = len(self.variants)
        self.weight = {g: math.log(1 + n / c) for g, c in counts.items()}
        self.unseen = math.log(1 + n)
        self._alike: dict[str, frozenset[str]] = {}

    def alike(self, word: str) -> frozenset[str]:
        """Words of the list that ``word`` equals, abbreviates or nearly equals, found through their trigrams."""
        if (known := self._alike.get(word)) is None:
            if len(self._alike) > 200_000:
                self._alike.clear()
            met = set().union(*(self.words_with.get(g, ()) for g in set(grams([word]))))
            known = self._alike[word] = frozenset(b for b in met if word_fits(word, b))
        return known

    def candidates(self, full: str, tokens: tuple[str, ...]) -> set[int]:
        """Variants whose every word is met by the word in its place, or that share a part with the whole at about its place."""
        found: set[int] | None = None
        for i, word in enumerate(tokens):
            here = set().union(*(self.at.get((len(tokens), i, b), ()) for b in self.alike(word)))
            found = here if found is None else found & here
            if not found:
                break
        found = found or set()
        for length in range(max(8, len(full) - 2), len(full) + 3):
            for i in range(5):
                start, end = length * i // 5, length * (i + 1) // 5
                for shift in range(max(-2, -start), 3):
                    found = found | self.pieces.get((length, i, full[start + shift : end + shift]), set())
        return found

    def cosine(self, a: list[str] | tuple[str, ...], b: list[str] | tuple[str, ...]) -> float:
        """Weighted cosine of trigrams; a word of b that a abbreviates counts as abbreviated likewise."""
        if len(a) == len(b):
            b = [x if y.startswith(x) else y for x, y in zip(a, b)]
        x, y = Counter(grams(a)), Counter(grams(b))
        w = lambda g: self.weight.get(g, self.unseen)
        dot = sum(n * y[g] * w(g) ** 2 for g, n in x.items() if g in y)
        norm = math.sqrt(sum((n * w(g)) ** 2 for g, n in x.items()) * sum((n * w(g)) ** 2 for g, n in y.items()))
        return dot / norm if norm else 0.0

    def fits(self, full: str, tokens: list[str], v: Variant) -> bool:
        """Exact check: every word equals, abbreviates or nearly equals its partner, or the whole is within two edits."""
        if len(tokens) == len(v.words) and all(map(word_fits, tokens, v.words)):
            return True
        return len(v.full) > 7 and abs(len(full) - len(v.full)) <= 2 and any(part in full for part in v.parts) and near(full, v.full, 2)

    def match(self, value: str) -> tuple[int, float]:
        """(entry, score); entry 0 if none is close enough or two are equally close."""
        full = stripped(value, self.tails)
        code = re.sub(r"[^a-z0-9]", "", full)
        if code in self.codes:
            return self.codes[code], 1.0
        every = words(full)
        readings = {tuple(w for w in every if w not in STOP), tuple(w for w in every if w not in STOP or w == "the")}
        best: dict[int, float] = {}
        for tokens in readings:
            if not tokens:
                continue
            for k in sorted(self.candidates(full, tokens)):
                v = self.variants[k]
                if not self.fits(full, list(tokens), v):
                    continue
                if "the" in every and v.words[0] != "the":  # an article, unless the other words are cut short too
                    cut = len(tokens) == len(v.words) and any(a != b and b.startswith(a) and a != "the" for a, b in zip(tokens, v.words))
                    if cut != ("the" in tokens):
                        continue
                if (score := self.cosine(tokens, v.words)) >= THRESHOLD:
                    best[v.ref_id] = max(best.get(v.ref_id, 0.0), score)
        ranked = sorted(best.items(), key=lambda kv: (-kv[1], kv[0]))
        if not ranked or len(ranked) > 1 and ranked[0][1] - ranked[1][1] < MARGIN:
            return 0, ranked[0][1] if ranked else 0.0
        return ranked[0]


def map_to_reference(values: DataFrame, reference: DataFrame) -> DataFrame:
    """``kind, value, ref_id, score`` for every distinct ``(kind, value)`` of ``values``; ``ref_id`` 0 for none.

    ``reference`` has ``ref_id, kind, canonical_name, alt_name, short_code``. Null and blank values are left out; a kind
    without entries maps to 0; two entries equally close give 0; repeated rows count once; an empty table gives an empty
    one; texts of any length are read whole. Other columns are ignored. A reference list of more than ``MAX_REFERENCE``
    rows is an error.
    """
    rows = reference.select("ref_id", "kind", "canonical_name", "alt_name", "short_code").limit(MAX_REFERENCE + 1).collect()
    if len(rows) > MAX_REFERENCE:
        raise ValueError(f"the reference list has more than {MAX_REFERENCE} rows")
    by_kind: dict[str, list] = defaultdict(list)
    for r in sorted((r for r in rows if r["ref_id"] is not None), key=lambda r: r["ref_id"]):
        by_kind[r["kind"]].append((r["ref_id"], [r["canonical_name"], r["alt_name"]], r["short_code"]))

    entries = dict(by_kind)
    distinct = values.select("kind", "value").filter(F.trim("value") != "").distinct()
    # few bytes but much work: spread by number, or adaptive execution would put them all into one task
    distinct = distinct.repartition(int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    tails = additions(distinct, entries)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers: dict[str, Matcher] = {}
        for b in batches:
            found = []
            for kind, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if kind not in matchers:
                    matchers[kind] = Matcher(entries.get(kind, []), kind != "journal", tails.get(kind, frozenset()))
                found.append(matchers[kind].match(value))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.float64())], names=["kind", "value", "ref_id", "score"])

    return distinct.mapInArrow(match, "kind string, value string, ref_id int, score double")


def additions(distinct: DataFrame, entries: dict[str, list]) -> dict[str, frozenset[str]]:
    """For each kind the tails that follow many different entries of the list in ``distinct`` (``kind, value``).

    A tail counts once for an entry, however many values have both; values that are entries themselves tell nothing.
    More than ``MAX_TAILS`` tails are an error.
    """
    known = {kind: {plain(n).strip(" .,;:"): rid for rid, names, _ in rows for n in names if n and n.strip()} for kind, rows in entries.items()}

    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: set[tuple[str, str, int]] = set()
            for kind, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                names, text = known.get(kind, {}), plain(value).strip(" .,;:")
                if text not in names:
                    out |= {(kind, tail, names[head]) for head, tail in heads_and_tails(text) if tail and head in names}
            rows = sorted(out)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int32())], names=["kind", "tail", "entry"])

    least = F.greatest(F.lit(TAIL_ENTRIES), F.ceil(F.lit(TAIL_SHARE) * F.col("entries")))
    sizes = distinct.sparkSession.createDataFrame([(kind, len(rows)) for kind, rows in entries.items()] or [("", 0)], "kind string, entries int")
    counted = distinct.mapInArrow(divide, "kind string, tail string, entry int").groupBy("kind", "tail").agg(F.countDistinct("entry").alias("n"))
    rows = counted.join(F.broadcast(sizes), "kind").filter(F.col("n") >= least).select("kind", "tail").limit(MAX_TAILS + 1).collect()
    if len(rows) > MAX_TAILS:
        raise ValueError(f"more than {MAX_TAILS} additions")
    return {kind: frozenset(r["tail"] for r in rows if r["kind"] == kind) for kind in entries}


def p7_found(entries: DataFrame, records: DataFrame, reference: DataFrame) -> DataFrame:
    """Values of faculty, ou and journal that aren't canonical names, with the entry meant or 0."""
    people = entries.select("resource_id", "entry_pos", F.inline(F.array(
        F.struct(F.lit("faculty").alias("field_name"), F.lit("faculty").alias("kind"), F.col("faculty").alias("value")),
        F.struct(F.lit("ou").alias("field_name"), F.lit("ou").alias("kind"), F.col("ou").alias("value")),
    )))
    journals = records.select("resource_id", F.posexplode("dc_relation_ispartof").alias("p", "value"))
    journals = journals.select("resource_id", (F.col("p") + 1).cast("int").alias("entry_pos"), F.lit("dc_relation_ispartof").alias("field_name"), F.lit("journal").alias("kind"), "value")
    values = people.unionByName(journals).filter(F.trim("value") != "")
    exact = reference.select("kind", F.col("canonical_name").alias("value")).distinct()
    values = values.join(exact, ["kind", "value"], "left_anti")
    mapped = map_to_reference(values, reference)
    found = values.join(mapped, ["kind", "value"])
    return found.select("field_name", F.col("resource_id").cast("bigint").alias("resource_id"), F.col("entry_pos").cast("int").alias("entry_pos"), "ref_id").distinct()
