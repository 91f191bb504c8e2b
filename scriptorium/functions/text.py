"""Text functions as native column expressions: nothing here leaves the JVM."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F

# Single wrong characters and what they stand for.
CHAR_FIXES = {"\ue09d": "ft", "\ue104": "fl", "\ue103": "fi", "Ā": "“", "Ĝ": "ř", "Ĥ": "ů", "\u0bc5": "–", "\u0131": "í"}
# Diacritics that stand alone.
STANDALONE_DIACRITICS = "\u02c7\u02dd\u02da\u0301\u00b4\u02d8\u0308\u00a8\u02c6"
# No-break blanks.
NO_BREAK = "\u00a0\u202f\u2007"
# Damaged multi-byte sequences, DOI form, DOI prefixes.
MOJIBAKE = "\ufffd|Ã[\u0080-\u00ff]|\u00e2\u0080[^\\s]"
DOI_FORM = r"^10\.\d{4,9}/[-._;()/:A-Za-z0-9]+$"
DOI_PREFIXES = ("https://doi.org/", "http://doi.org/", "https://dx.doi.org/", "http://dx.doi.org/", "doi:")
# Dashes, quotes and punctuation that titles are compared without.
TITLE_PUNCTUATION = r"[\x{2010}-\x{2015}\x{2212}\-_.,;:!?()\[\]{}\"'`\x{2018}-\x{201F}\x{00AB}\x{00BB}/\\]"


@lru_cache(maxsize=1)
def _bases() -> tuple[str, str]:
    """Composed letters and their base letters, by rule from the Unicode tables."""
    composed, base = [], []
    for cp in range(0xC0, 0x2FFF):
        ch = chr(cp)
        parts = unicodedata.normalize("NFD", ch)
        if len(parts) > 1 and all(unicodedata.category(p) == "Mn" for p in parts[1:]):
            composed.append(ch)
            base.append(parts[0])
    return "".join(composed), "".join(base)


def strip_accents(col: Column) -> Column:
    """Canonical decomposition without its nonspacing marks."""
    composed, base = _bases()
    return F.regexp_replace(F.translate(col, composed, base), r"\p{Mn}", "")


def squeeze(col: Column) -> Column:
    """Runs of any white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(col, r"(?U)\s+", " "))


def normalise(col: Column) -> Column:
    """Lower case, no accents, single blanks; null becomes the empty text."""
    return F.coalesce(squeeze(strip_accents(F.lower(col))), F.lit(""))


def match_form(col: Column) -> Column:
    """:func:`normalise` with everything but letters, digits and underscores as blanks."""
    return squeeze(F.regexp_replace(normalise(col), r"(?U)[^\w\s]", " "))


def workplace_form(col: Column) -> Column:
    """:func:`match_form` with the spellings of 'and' and 'centre' made one."""
    return match_form(F.regexp_replace(F.replace(normalise(col), F.lit("&"), F.lit(" and ")), r"\bcenter\b", "centre"))


def title_form(col: Column) -> Column:
    """Title for comparison: lower case, no accents, punctuation as blanks."""
    return F.coalesce(squeeze(F.regexp_replace(strip_accents(F.lower(col)), TITLE_PUNCTUATION, " ")), F.lit(""))


def value_form(col: Column) -> Column:
    """First element of an array, trimmed, lower case."""
    return F.lower(utrim(F.try_element_at(col, F.lit(1))))


def utrim(col: Column) -> Column:
    """Trim of all Unicode white space."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def year_of(col: Column) -> Column:
    """First year 1900-2099 that stands alone in a text."""
    return F.nullif(F.regexp_extract(col, r"\b((?:19|20)\d{2})\b", 1), F.lit("")).try_cast("int")


def issn_form(col: Column) -> Column:
    """Digits and x only, lower case."""
    return F.lower(F.regexp_replace(col, r"[^0-9xX]", ""))


def authors_form(col: Column) -> Column:
    """Names normalised, sorted and joined."""
    return F.array_join(F.array_sort(F.transform(col, normalise)), "|")


def title_keys(title: Column) -> Column:
    """Block keys of a normalised title: 16 and 24 characters, first two and last two words, first three words."""
    words = F.filter(F.split(title, " "), lambda w: w != "")
    n = F.size(words)
    tag = lambda k, c: F.concat(F.lit(k + ":"), c)
    keys = F.array(
        F.when(F.length(title) > 0, tag("p16", F.substring(title, 1, 16))),
        F.when(F.length(title) > 0, tag("p24", F.substring(title, 1, 24))),
        F.when(n >= 2, tag("f2", F.array_join(F.slice(words, 1, 2), " "))),
        F.when(n >= 2, tag("l2", F.array_join(F.slice(words, F.greatest(n - 1, F.lit(1)), F.lit(2)), " "))),
        F.when(n >= 3, tag("f3", F.array_join(F.slice(words, 1, 3), " "))),
    )
    return F.array_distinct(F.array_compact(keys))


def fix_characters(col: Column) -> Column:
    """Known wrong characters replaced."""
    for wrong, right in CHAR_FIXES.items():
        col = F.replace(col, F.lit(wrong), F.lit(right))
    return col


# What Western bytes 80 to 9F are read as, and these bytes.
WESTERN = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
WESTERN_BYTES = "\u0080\u0082\u0083\u0084\u0085\u0086\u0087\u0088\u0089\u008a\u008b\u008c\u008e\u0091\u0092\u0093\u0094\u0095\u0096\u0097\u0098\u0099\u009a\u009b\u009c\u009e\u009f"
#: Where the characters of a text, taken as bytes, aren't well-formed UTF-8 (searched for, so long texts need no deep match).
NOT_UTF8 = (
    r"[^\x00-\xFF]|[\xC0\xC1\xF5-\xFF]|[\xC2-\xDF](?![\x80-\xBF])|[\xE0-\xEF](?![\x80-\xBF]{2})|[\xF0-\xF4](?![\x80-\xBF]{3})"
    r"|(?<![\xC2-\xF4])(?<![\xE0-\xF4][\x80-\xBF])(?<![\xF0-\xF4][\x80-\xBF]{2})[\x80-\xBF]|\xE0[\x80-\x9F]|\xED[\xA0-\xBF]|\xF0[\x80-\x8F]|\xF4[\x90-\xBF]"
)


def fix_mojibake(col: Column) -> Column:
    """UTF-8 that was read as a Western encoding read again, where the whole text allows it; else the text as it is."""
    as_bytes = F.translate(col, WESTERN, WESTERN_BYTES)
    damaged = as_bytes.rlike(r"[\x80-\xFF]") & ~as_bytes.rlike(NOT_UTF8)
    return F.when(damaged, F.decode(F.encode(as_bytes, "ISO-8859-1"), "UTF-8")).otherwise(col)


def text_fixes(col: Column) -> tuple[Column, list[tuple[str, Column]]]:
    """Fixed text, and for each kind of fix in order whether it changed something.

    Order: wrong encoding, wrong characters, standalone diacritics, no-break blanks, doubled blanks, blanks at the ends.
    """
    steps = [
        ("mojibake", fix_mojibake),
        ("encoding_chars", fix_characters),
        ("standalone_diacritics", lambda c: F.regexp_replace(c, f"[{STANDALONE_DIACRITICS}]", "")),
        ("nbsp", lambda c: F.translate(c, NO_BREAK, "   ")),
        ("double_space", lambda c: F.regexp_replace(c, " {2,}", " ")),
        ("trailing_spaces", utrim),
    ]
    made = []
    for kind, step in steps:
        after = step(col)
        made.append((kind, after != col))
        col = after
    return col, made


def has_encoding_chars(col: Column) -> Column:
    return col.rlike("[" + "".join(CHAR_FIXES) + "]")


def has_standalone_diacritics(col: Column) -> Column:
    return col.rlike(f"[{STANDALONE_DIACRITICS}]")


def has_mojibake(col: Column) -> Column:
    return col.rlike(MOJIBAKE)


def has_nbsp(col: Column) -> Column:
    return col.rlike(f"[{NO_BREAK}]")


def has_double_space(col: Column) -> Column:
    return col.rlike(" {2,}")


def has_outer_space(col: Column) -> Column:
    return col.rlike(r"(?U)^\s|\s$")


def is_doi(col: Column) -> Column:
    """Whether a DOI has the bare form; null and empty are fine."""
    return F.coalesce(utrim(col) == "", F.lit(True)) | col.rlike(DOI_FORM)


def clean_doi(col: Column) -> Column:
    """DOI without one URL prefix, query, fragment and final slashes."""
    prefixes = "|".join(p.replace(".", r"\.") for p in DOI_PREFIXES)
    bare = F.regexp_replace(utrim(col), rf"(?i)^(?:{prefixes})", "")
    return F.regexp_replace(F.regexp_replace(utrim(bare), r"(?s)[?#].*$", ""), r"/+$", "")


def clean_url(col: Column) -> Column:
    """URL without its query."""
    return F.substring_index(col, "?", 1)


def parse_issns(col: Column) -> Column:
    """Distinct ISSNs of an array whose elements may hold several: nine characters with a hyphen in the middle, lower case."""
    parts = F.transform(F.flatten(F.transform(col, lambda x: F.split(x, ","))), lambda p: F.lower(utrim(p)))
    return F.array_distinct(F.filter(parts, lambda p: (F.length(p) == 9) & (F.substring(p, 5, 1) == "-")))


def parse_isbns(col: Column) -> Column:
    """Distinct ISBNs of an array: 10 or 13 characters without hyphens and blanks, all but the last digits."""
    parts = F.transform(F.flatten(F.transform(col, lambda x: F.split(x, ","))), lambda p: F.regexp_replace(p, r"[-\s]", ""))
    return F.array_distinct(F.filter(parts, lambda p: p.rlike(r"^(?:\d{9}|\d{12}).$")))


def split_display(col: Column) -> Column:
    """Values of a displayed field, divided by ``||``."""
    return F.filter(F.transform(F.split(col, r"\s*\|\|\s*"), utrim), lambda x: x != "")


def to_display(col: Column) -> Column:
    """Array as a displayed field."""
    return F.array_join(col, "||")


def first_non_empty(col: Column) -> Column:
    """First element that isn't null or blank, trimmed."""
    return F.try_element_at(F.filter(F.transform(col, utrim), lambda x: x != ""), F.lit(1))


def merge_ordered(left: Column, right: Column) -> Column:
    """Union of two arrays in order, one value of each normal form, the first."""
    both = F.concat(F.coalesce(left, F.array().cast("array<string>")), F.coalesce(right, F.array().cast("array<string>")))
    kept = F.filter(both, lambda x: x.isNotNull() & (utrim(x) != ""))
    return F.aggregate(kept, F.array().cast("array<string>"), lambda acc, x: F.when(F.exists(acc, lambda a: normalise(a) == normalise(x)), acc).otherwise(F.array_append(acc, x)))


def strip_jats(col: Column) -> Column:
    """Text without JATS tags."""
    return utrim(F.regexp_replace(col, r"(?i)</?jats:[^>]*>", ""))


def name_words(col: Column) -> Column:
    """Words of letters of a name without accents."""
    return F.regexp_extract_all(strip_accents(F.lower(col)), F.lit(r"([a-z]+)"), 1)


def external_id(col: Column, kind: str) -> Column:
    """ORCID, Scopus or WoS author id written in a text."""
    patterns = {"orcid": r"(\d{4}-\d{4}-\d{4}-\d{3}[\dX])", "scopus": r"(?<!\d)(\d{8,11})(?!\d)", "wos": r"\b([A-Z]{1,3}-\d{4}-\d{4})\b"}
    return F.nullif(F.regexp_extract(col, patterns[kind], 1), F.lit(""))


def common_prefix_ratio(a: Column, b: Column) -> Column:
    """Length of the common beginning over the longer length; 0 for two empty texts."""
    longer = F.greatest(F.length(a), F.length(b))
    places = F.sequence(F.lit(1), F.greatest(F.least(F.length(a), F.length(b)), F.lit(1)))
    same = F.size(F.filter(places, lambda k: (F.substring(a, F.lit(1), k) == F.substring(b, F.lit(1), k)) & (k <= F.least(F.length(a), F.length(b)))))
    return F.when(longer == 0, 0.0).otherwise(same / longer)
