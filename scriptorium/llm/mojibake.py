"""Text decoded with the wrong character encoding: a best-first search over encode, decode and unescape steps.

Plan: one Arrow pass counts character trigrams that hold a non-ASCII character, hashed into a table of fixed size, over
all texts; the table (``BUCKETS`` numbers, whatever the input) goes to the tasks. A second pass searches each
non-ASCII word of each element and keeps the elements that change or hold characters lost for good. Nothing else shuffles.
"""

from __future__ import annotations

import heapq
import html.entities
import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BUCKETS = 1 << 20
#: A single-byte misreading must be this much more plausible (nats for each changed character) to be taken back.
MARGIN = 2.0
#: The same for Central European letters that would have to be Western ones, the rarer error.
RARE_MARGIN = 5.0
#: A word may have been decoded and unescaped any number of times (each step makes it shorter), but was read with a wrong
#: single-byte encoding at most so often: what makes the search finite. Within it nothing is cut but paths that can't win.
SINGLE_BYTE_STEPS = 2
#: What an entity or escape that stands for a character costs: more than any one character does.
UNRESOLVED = 40.0

# Fixed values: (encoding that the text was wrongly read with, true encoding).
MULTIBYTE = tuple((wrong, "utf-8") for wrong in ("cp1252", "latin-1", "cp1250", "mac_roman", "cp852", "cp437", "cp850", "cp1251", "iso8859_2"))
# The third value says which words it is tried on: any; mostly non-ASCII ones (another alphabet); those with an odd sign.
SINGLE_BYTE = (
    ("cp1252", "cp1250", "any"), ("cp1252", "iso8859_2", "any"), ("cp1250", "cp1252", "any"), ("iso8859_2", "cp1252", "any"),
    ("iso8859_2", "cp1250", "odd"), ("cp1250", "iso8859_2", "odd"), ("cp852", "cp1250", "odd"), ("cp850", "cp1250", "odd"),
    ("mac_roman", "cp1250", "odd"), ("cp1252", "mac_roman", "odd"), ("cp1252", "cp852", "odd"), ("cp1252", "cp1251", "mostly"), ("cp1252", "koi8_r", "mostly"),
)

_NON_ASCII = re.compile(r"[^\x00-\x7f]")
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});")
_ESCAPE = re.compile(r"(?:\\u[0-9a-fA-F]{4})+")
_NESTED = "&(?:amp;)*" + _ENTITY.pattern[1:]
# A word that holds a sign of damage, whole entities with it; a no-break space divides words unless it may be the second byte of a damaged letter.
_PART = rf"(?:{_NESTED}|[^\s\x00-\x25\x27-\x2b\x2c\x3b\[\]]|(?<=[À-ɏ])[\x85\xa0])"
_CHUNK = re.compile(rf"{_PART}*?(?:{_NESTED}|[^\s\x00-\x25\x27-\x5b\x5d-\x7f]){_PART}*")
# Alphabets, and signs, that are usual beside Latin letters.
_FAMILIAR = frozenset("LATIN GREEK CYRILLIC MICRO FEMININE MASCULINE SUPERSCRIPT VULGAR MODIFIER CARON".split())
_ASCII_LETTER = re.compile("[A-Za-z]")
_USUAL = frozenset("°–—“”„‘’‚…±×µ§€")
_LETTER = r"[^\W\d_]"
_LOST_IN_WORD = re.compile(rf"{_LETTER}\?+{_LETTER}|(?:(?<=\s)|^)\?+{_LETTER}{{2}}|{_LETTER}\?+ +(?=[a-zà-ž])")


@lru_cache(maxsize=10_000)
def _script(ch: str) -> str:
    """Alphabet of a letter."""
    return unicodedata.name(ch, "?").split(" ")[0]


def trigrams(text: str) -> list[str]:
    """Trigrams of the padded text that hold a non-ASCII character; digits are one symbol."""
    padded = " " + re.sub(r"\d", "0", text) + " "
    out = []
    for m in _NON_ASCII.finditer(padded):
        k = m.start()
        out += [padded[i : i + 3] for i in range(max(0, k - 2), min(len(padded) - 2, k + 1))]
    return out


def bucket(gram: str) -> int:
    """Place of a trigram in the table; the same in every process."""
    return zlib.crc32(gram.encode("utf-8", "surrogatepass")) & (BUCKETS - 1)


@lru_cache(maxsize=None)
def _bytes_of(encoding: str) -> dict[str, int]:
    """Character to byte. Bytes that the encoding leaves undefined are read as control characters, as browsers do."""
    out = {}
    for b in range(256):
        try:
            out.setdefault(bytes([b]).decode(encoding), b)
        except UnicodeDecodeError:
            out.setdefault(chr(b), b)
    return out


@lru_cache(maxsize=None)
def _sequences(encoding: str) -> re.Pattern:
    """What valid multi-byte UTF-8 sequences look like when read with ``encoding``."""
    chars = {b: re.escape(ch) for ch, b in _bytes_of(encoding).items()}
    some = lambda low, high: "[" + "".join(chars[b] for b in range(low, high + 1) if b in chars) + "]"
    tail = some(0x80, 0xBF)
    return re.compile(f"{some(0xC2, 0xDF)}{tail}|{some(0xE0, 0xEF)}{tail}{{2}}|{some(0xF0, 0xF4)}{tail}{{3}}")


def _decode_runs(text: str, encoding: str) -> str:
    """``text`` with every run that is UTF-8 once encoded replaced, for damage may be partial even inside a word."""
    table = _bytes_of(encoding)

    def read(m: re.Match) -> str:
        try:
            return bytes(table[ch] for ch in m[0]).decode("utf-8")
        except UnicodeDecodeError:
            return m[0]

    return _sequences(encoding).sub(read, text)


@lru_cache(maxsize=1)
def _any_sequence() -> re.Pattern:
    """Matches where any of the encodings reads a multi-byte sequence: one test instead of one for each encoding."""
    return re.compile("|".join(_sequences(wrong).pattern for wrong, _ in MULTIBYTE))


@lru_cache(maxsize=None)
def _rereading(wrong: str, true: str) -> tuple[frozenset[str], dict[int, str]]:
    """Non-ASCII characters that ``wrong`` can encode, and those that ``true`` reads differently."""
    able, changed = set(), {}
    for ch, b in _bytes_of(wrong).items():
        if b < 0x80 or ch.isascii() or ch in "\xa0\xad":  # invisible signs are no misread letters
            continue
        try:
            other = bytes([b]).decode(true)
        except UnicodeDecodeError:
            continue
        able.add(ch)
        if other != ch:
            changed[ord(ch)] = other
    return frozenset(able), changed


def _character(entity: str) -> str:
    """What an entity stands for; itself if it isn't known or stands for no character of a text."""
    if entity[1] != "#" and entity[1:] not in html.entities.html5:
        return entity
    plain = html.unescape(entity)
    return plain if plain and plain != "\ufffd" and (plain >= " " or plain in "\t\n") else entity


def _characters(escapes: str) -> str:
    r"""What a run of \uXXXX stands for, surrogates in pairs; escapes that stand for no character stay."""
    plain = b"".join(bytes.fromhex(e) for e in escapes.split("\\u")[1:]).decode("utf-16-be", "surrogatepass")
    return "".join(f"\\u{ord(ch):04x}" if ch < " " or "\ud800" <= ch <= "\udfff" else ch for ch in plain)


def unescape(text: str) -> str:
    """``text`` with every entity undone once."""
    return _ENTITY.sub(lambda m: _character(m[0]), text) if "&" in text else text


def unresolved(text: str) -> int:
    """Entities and escapes that stand for a character."""
    n = sum(_character(m[0]) != m[0] for m in _ENTITY.finditer(text)) if "&" in text else 0
    return n + (sum(len(m[0]) // 6 for m in _ESCAPE.finditer(text) if _characters(m[0]) != m[0].lower()) if "\\u" in text else 0)


def steps(text: str) -> Iterator[tuple[str, float, int]]:
    """Texts one operation away, what the operation itself costs, and whether it rereads single bytes."""
    if (plain := unescape(text)) != text:
        yield plain, 0.5, 0
    if "\\u" in text and (plain := _ESCAPE.sub(lambda m: _characters(m[0]), text)) != text:
        yield plain, 0.5, 0
    foreign = [ch for ch in text if ch > "\x7f"]
    if not foreign:
        return
    for wrong, _ in MULTIBYTE if _any_sequence().search(text) else ():
        if (fixed := _decode_runs(text, wrong)) != text:
            yield fixed, 1.0, 0
    mostly = 2 * len(foreign) > len(text)
    odd = any(not ch.isalpha() for ch in foreign)
    for wrong, true, needs in SINGLE_BYTE:
        if needs == "mostly" and not mostly or needs == "odd" and not odd:
            continue
        able, changed = _rereading(wrong, true)
        n = sum(ord(ch) in changed for ch in foreign)
        if n and all(ch in able for ch in foreign):
            yield text.translate(changed), (MARGIN if true != "cp1252" else RARE_MARGIN) * n, 1


class Plausibility:
    """What a text costs by the trigram counts of the corpus; control characters and lost characters cost extra."""

    def __init__(self, counts: np.ndarray) -> None:
        total = float(counts.sum()) + 0.1 * BUCKETS
        self._by_bucket = -np.log((counts + 0.1) / total) / 3
        self._by_gram: dict[str, float] = {}
        self._memo: dict[str, str] = {}

    def _gram(self, gram: str) -> float:
        if (cost := self._by_gram.get(gram)) is None:
            if len(self._by_gram) > 500_000:
                self._by_gram.clear()
            cost = self._by_gram[gram] = float(self._by_bucket[bucket(gram)])
        return cost

    def __call__(self, text: str) -> float:
        cost = sum(map(self._gram, trigrams(text))) + UNRESOLVED * unresolved(text)
        scripts, odd, rare = set(), 0, 0
        for ch in text:
            if ch > "\x7f":
                if "\x80" <= ch <= "\x9f" or ch == "\ufffd":
                    cost += 12
                elif ch > "\u052f" and not "\u2000" <= ch <= "\u25ff" and unicodedata.normalize("NFKC", ch) == ch:
                    rare += 1
                elif ch.isalnum():
                    scripts.add(_script(ch))
                elif ch not in _USUAL:
                    odd += 1
        if (rare and scripts) or (rare or scripts - _FAMILIAR) and _ASCII_LETTER.search(text):  # such signs stand beside Latin letters in few languages
            odd += 6 * rare + 8 * bool(scripts - _FAMILIAR)
        return cost + 4 * odd + 30 * max(0, len(scripts) - 1)

    def restore(self, chunk: str) -> str:
        """Cheapest text reachable from ``chunk``: best-first, a state visited again only on a cheaper path."""
        if (known := self._memo.get(chunk)) is not None:
            return known
        best, best_cost = chunk, self(chunk)
        heap: list[tuple[float, int, str, float, int]] = [(best_cost, 0, chunk, 0.0, 0)]
        paid_for = {(chunk, 0): 0.0}
        order = 0
        while heap:
            cost, _, text, paid, reread = heapq.heappop(heap)
            if cost < best_cost:
                best, best_cost = text, cost
            for after, price, single in steps(text):
                state = after, reread + single
                # a text costs at least 0, so a path that has paid the best cost can't win
                if state[1] > SINGLE_BYTE_STEPS or paid + price >= min(best_cost, paid_for.get(state, math.inf)):
                    continue
                paid_for[state] = paid + price
                order += 1
                heapq.heappush(heap, (self(after) + paid + price, order, after, paid + price, state[1]))
        if len(self._memo) > 200_000:
            self._memo.clear()
        self._memo[chunk] = best
        return best

    def repair(self, text: str) -> str:
        """``text`` with every word restored as far as possible."""
        return _CHUNK.sub(lambda m: self.restore(m[0]), text)


def is_lost(text: str, is_name: bool) -> bool:
    """Whether characters are gone for good: a replacement character, or a question mark in the place of a letter."""
    if "�" in text:
        return True
    if "?" not in text:
        return False
    return is_name or _LOST_IN_WORD.search(text) is not None


_FOUND = pa.schema([("row_id", pa.int64()), ("field_name", pa.string()), ("value_pos", pa.int32()), ("original", pa.string()), ("repaired", pa.string()), ("lost", pa.bool_())])
_FOUND_DDL = "row_id bigint, field_name string, value_pos int, original string, repaired string, lost boolean"


def _elements(records: DataFrame, fields: tuple[str, ...], row_id: str) -> DataFrame:
    cols = [F.filter(F.transform(F.col(f"`{f}`"), lambda x, i: F.struct((i + 1).cast("int").alias("pos"), x.alias("text"))), lambda s: s["text"].rlike(r"[^\x00-\x25\x27-\x3E\x40-\x5B\x5D-\x7F]")) for f in fields]
    entries = F.array(*[F.struct(F.lit(f).alias("field_name"), c.alias("elements")) for f, c in zip(fields, cols)])
    return records.select(F.col(f"`{row_id}`").cast("bigint").alias("row_id"), F.inline(entries)).filter(F.size("elements") > 0)


def corpus_counts(records: DataFrame, fields: tuple[str, ...], row_id: str = "resource_id") -> np.ndarray:
    """Trigram counts of all texts in a table of ``BUCKETS`` places."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        places = np.zeros(BUCKETS, dtype=np.int64)

        def flush() -> None:
            for gram, n in total.items():
                places[bucket(gram)] += n
            total.clear()

        for b in batches:
            for elements in b.column(0).to_pylist():
                for text in elements or ():
                    if not text.isascii():
                        total.update(trigrams(text))
            if len(total) > 200_000:
                flush()
        flush()
        at = np.nonzero(places)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(places[at])], names=["at", "n"])

    texts = _elements(records, fields, row_id).select(F.transform("elements", lambda s: s["text"]).alias("texts"))
    rows = texts.mapInArrow(count, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, dtype=np.int64)
    out[rows.column("at").to_numpy()] = rows.column("n").to_numpy()
    return out


def repair_encoding(records: DataFrame, fields: tuple[str, ...], *, row_id: str = "resource_id", name_fields: tuple[str, ...] = (), counts: np.ndarray | None = None) -> DataFrame:
    """Array elements that were decoded or stored wrongly: ``row_id, field_name, value_pos, original, repaired, lost``.

    ``counts``: trigram counts to judge by, else those of ``records``. ``repaired`` is the cheapest text reachable; ``lost`` tells that some characters can't be given back. In
    ``name_fields`` every question mark stands for a lost character. Null rows, arrays and elements and empty texts give
    no rows; repeated rows give repeated results; an empty table an empty result; a text of any length is searched word
    by word; of equally cheap texts the one reached first is taken. Other columns are ignored.
    """
    counts = corpus_counts(records, fields, row_id) if counts is None else counts

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plausible = Plausibility(counts)
        for b in batches:
            out: list[list] = [[] for _ in _FOUND.names]
            lists = b.column(2)
            ends, places, texts = lists.offsets.to_pylist(), lists.values.field("pos").to_pylist(), lists.values.field("text").to_pylist()
            for rid, field, i, j in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), ends, ends[1:]):
                for k in range(i, j):
                    text = texts[k]
                    fixed, lost = plausible.repair(text), is_lost(text, field in name_fields)
                    if fixed != text or lost:
                        for column, value in zip(out, (rid, field, places[k], text, fixed, lost)):
                            column.append(value)
            yield pa.RecordBatch.from_pydict(dict(zip(_FOUND.names, out)), schema=_FOUND)

    return _elements(records, fields, row_id).mapInArrow(search, _FOUND_DDL)


def p4_found(records: DataFrame) -> DataFrame:
    """Elements of titles, authors and WoS affiliations that are damaged, wholly or in part."""
    found = repair_encoding(records, ("dc_title", "dc_contributor_author", "utb_wos_affiliation"), name_fields=("dc_contributor_author", "utb_wos_affiliation"))
    return found.select(F.col("row_id").alias("resource_id"), "field_name", "value_pos").filter("resource_id is not null").distinct()
