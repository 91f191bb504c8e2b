"""Quote-aware tokenizer for several values packed into one text."""

from __future__ import annotations

from typing import NamedTuple

# Brackets that nest, and the quotes that open and close a value.
OPEN_TO_CLOSE = {"[": "]", "(": ")", "{": "}"}
QUOTES = {'"': '"', "“": "”", "„": "“"}
BLANKS = " \t\r\n\xa0"


class Dialect(NamedTuple):
    """How a field packs values.

    ``strong`` delimiters always divide outside quotes and brackets; ``weak`` ones only in a text without a strong one,
    and, where ``weak_needs_quotes``, only next to a quoted value (names hold commas themselves). ``weak_words`` is the
    least number of words that each part must have (a place after a comma is no value of its own).
    """

    strong: str = "|;\n\t"
    weak: str = ""
    weak_needs_quotes: bool = False
    weak_words: int = 1


AFFILIATIONS = Dialect()
NAMES = Dialect(weak=",", weak_needs_quotes=True)
UNITS = Dialect(weak=",", weak_words=2)
IDENTIFIERS = Dialect(strong="|;\n\t, /")
ONE_VALUE = Dialect(strong="")


def _scan(text: str, delimiters: str, after_quote: str = "") -> list[tuple[str, bool, str]]:
    """(value, was quoted, delimiter after it) in order; blank values are left out. ``after_quote`` divides there only.

    Finite-state: OUTSIDE reads the start of a value, QUOTED runs to the closing quote, BARE to a delimiter. A quote
    opens only at the start of a value and closes only before a delimiter or the end, so quotes inside a title or a
    name stay text. Inside quotes a doubled quote or a backslash escapes. An opening bracket without its partner is text.
    """
    out: list[tuple[str, bool, str]] = []
    n, at = len(text), 0
    while at <= n:
        while at < n and text[at] in BLANKS and text[at] not in delimiters:
            at += 1
        if at >= n:
            break
        quoted = False
        value, after = "", at
        if text[at] in QUOTES:  # QUOTED
            close, chars, i = QUOTES[text[at]], [], at + 1
            while i < n:
                ch = text[i]
                if ch == "\\" and i + 1 < n and text[i + 1] in (close, "\\"):
                    chars.append(text[i + 1])
                    i += 2
                elif ch == close and close == '"' and i + 1 < n and text[i + 1] == close:
                    chars.append(close)
                    i += 2
                elif ch == close:
                    end = i + 1
                    while end < n and text[end] in BLANKS and text[end] not in delimiters:
                        end += 1
                    if end >= n or text[end] in delimiters or text[end] in after_quote:
                        quoted, value, after = True, "".join(chars).strip(BLANKS), end
                    break
                else:
                    chars.append(ch)
                    i += 1
        if not quoted:  # BARE
            stack: list[str] = []
            i = at
            while i < n:
                ch = text[i]
                if ch in OPEN_TO_CLOSE and text.find(OPEN_TO_CLOSE[ch], i + 1) >= 0:
                    stack.append(OPEN_TO_CLOSE[ch])
                elif stack and ch == stack[-1]:
                    stack.pop()
                elif ch in delimiters and not stack:
                    break
                i += 1
            value, after = text[at:i].strip(BLANKS), i
        delimiter = text[after] if after < n else ""
        if value:
            out.append((value, quoted, delimiter))
        at = after + 1
    return out


def split_values(text: str | None, dialect: Dialect = AFFILIATIONS) -> list[str]:
    """The values of one text in order, without outer blanks and outer quoting; none for null, empty or blank texts."""
    text = (text or "").strip(BLANKS)
    if not text:
        return []
    if not dialect.strong and not dialect.weak:
        return [text]
    if text[0] == "{" and text[-1] == "}" and text.find("}") == len(text) - 1:  # array literal
        return [v for v, _, _ in _scan(text[1:-1], dialect.strong + ",")]
    if dialect.weak:
        every = _scan(text, dialect.strong + dialect.weak)
        if not any(d and d in dialect.strong for _, _, d in every):
            fits = all(len(v.split()) >= dialect.weak_words for v, _, _ in every)
            if len(every) > 1 and fits and (not dialect.weak_needs_quotes or any(q for _, q, _ in every)):
                return [v for v, _, _ in every]
    return [v for v, _, _ in _scan(text, dialect.strong, dialect.weak)]
