"""Reading one written date or timestamp: every valid interpretation of a text.

Everything here is plain Python on one value; ``operators.timestamps`` lifts it to DataFrames.
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from typing import NamedTuple
from zoneinfo import ZoneInfo

# Month names by number, English, Czech (nominative and genitive), Slovak, German, Spanish.
MONTHS = {
    1: "january jan leden ledna january januara januar enero ene",
    2: "february feb únor února february februara februar febrero",
    3: "march mar březen března marec marca märz marzo",
    4: "april apr duben dubna apríl apríla abril abr",
    5: "may květen května máj mája mai mayo",
    6: "june jun červen června jún júna juni junio",
    7: "july jul červenec července júl júla juli julio",
    8: "august aug srpen srpna august augusta agosto ago",
    9: "september sep sept září september septembra septiembre",
    10: "october oct říjen října október októbra oktober octubre",
    11: "november nov listopad listopadu november novembra noviembre",
    12: "december dec prosinec prosince december decembra dezember diciembre dic",
}
MONTH_OF = {name: number for number, names in MONTHS.items() for name in names.split()}

# Hours east of UTC of zone abbreviations.
ZONE_HOURS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 1, "BST": 1, "CET": 1, "CEST": 2, "MET": 1, "MEST": 2,
    "EET": 2, "EEST": 3, "MSK": 3, "IST": 5.5, "JST": 9, "KST": 9, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5,
    "MST": -7, "MDT": -6, "PST": -8, "PDT": -7, "AEST": 10, "AEDT": 11,
}

# Labels before dates in full texts.
LABELS = (
    "received in revised form", "manuscript received", "received", "submitted", "submission", "do redakce došlo",
    "došlo", "revised", "revision received", "přepracováno", "reviewed", "accepted for publication", "accepted",
    "přijato do tisku", "přijato", "published online", "first published online", "first published", "published",
    "date of publication", "publication date", "available online", "zveřejněno", "date submitted", "online first",
)

FIRST_YEAR, LAST_YEAR = 1000, 2999

_LABEL = re.compile(
    r"(?<!\w)(?:" + "|".join(re.escape(x).replace(r"\ ", r"\s+") for x in sorted(LABELS, key=len, reverse=True)) + r")(?!\w)\s*:?",
    re.IGNORECASE,
)
_TIME = r"(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,]\d+)?)?"
_ZONE = r"(?:\s*(?P<z>Z|[+-]\d{2}:?\d{2}|[+-]\d{2}|[A-Za-z]{2,4}))?"
_REST = rf"(?:(?:\s*[Tt,]\s*|\s+)(?:at\s+)?{_TIME}{_ZONE})?"
_WORD = r"[^\W\d_]{3,12}"


class Reading(NamedTuple):
    """One interpretation. ``form`` is the format family, ``cost`` how unusual it is, ``at`` its start as UTC seconds."""

    normal: str
    form: str
    cost: float
    at: float


def _compile(*shapes: tuple[str, str]) -> list[tuple[str, re.Pattern]]:
    return [(form, re.compile(pattern + r"\Z", re.IGNORECASE)) for form, pattern in shapes]


#: format family, pattern. Several families may read one text; the costs below choose between them.
_SHAPES = _compile(
    ("iso", rf"(?P<y>\d{{4}})-(?P<m>\d{{1,2}})-(?P<d>\d{{1,2}}){_REST}"),
    ("iso_month", r"(?P<y>\d{4})-(?P<m>\d{2})"),
    ("year", r"(?P<y>\d{4})"),
    ("slash_ymd", rf"(?P<y>\d{{4}})/(?P<m>\d{{1,2}})/(?P<d>\d{{1,2}}){_REST}"),
    ("dot_ymd", rf"(?P<y>\d{{4}})\.\s*(?P<m>\d{{1,2}})\.\s*(?P<d>\d{{1,2}})\.?{_REST}"),
    ("dot_dmy", rf"(?P<d>\d{{1,2}})\.\s*(?P<m>\d{{1,2}})\.\s*(?P<y>\d{{4}}|\d{{2}}){_REST}"),
    ("dot_mdy", rf"(?P<m>\d{{1,2}})\.\s*(?P<d>\d{{1,2}})\.\s*(?P<y>\d{{4}}|\d{{2}}){_REST}"),
    ("slash_mdy", rf"(?P<m>\d{{1,2}})/(?P<d>\d{{1,2}})/(?P<y>\d{{4}}|\d{{2}}){_REST}"),
    ("slash_dmy", rf"(?P<d>\d{{1,2}})/(?P<m>\d{{1,2}})/(?P<y>\d{{4}}|\d{{2}}){_REST}"),
    ("dash_dmy", rf"(?P<d>\d{{1,2}})-(?P<m>\d{{1,2}})-(?P<y>\d{{4}}){_REST}"),
    ("compact", rf"(?P<y>\d{{4}})(?P<m>\d{{2}})(?P<d>\d{{2}})(?:[Tt]?(?P<h>\d{{2}})(?P<mi>\d{{2}})(?P<s>\d{{2}}){_ZONE})?"),
    ("epoch_s", r"(?P<e>\d{9,10})"),
    ("epoch_ms", r"(?P<ems>\d{12,13})"),
    ("text_dmy", rf"(?:{_WORD},?\s+)?(?P<d>\d{{1,2}})(?:st|nd|rd|th|\.)?(?:\s+of)?[\s-]+(?P<mon>{_WORD})\.?,?[\s-]+(?P<y>\d{{4}}|\d{{2}}){_REST}"),
    ("text_mdy", rf"(?:{_WORD},?\s+)?(?P<mon>{_WORD})\.?\s+(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?P<y>\d{{4}}){_REST}"),
    ("text_ymd", rf"(?P<y>\d{{4}})[\s-]+(?P<mon>{_WORD})\.?[\s-]+(?P<d>\d{{1,2}}){_REST}"),
    ("text_month", rf"(?P<mon>{_WORD})\.?,?[\s-]+(?P<y>\d{{4}})"),
    ("num_month", r"(?P<m>\d{1,2})[/.]\s*(?P<y>\d{4})"),
)
#: What a reading against the stated conventions (dotted dates day first, slashed dates that end in the year month first)
#: costs, on the scale of the neighbours, where a change of format and a step back in time cost 1 each: more than what one
#: neighbour or the order in time alone can say (at most 1 for each value), less than what two neighbours that can only be
#: read the other way say (2). Of the two instants of a repeated civil hour no convention prefers one, so only the
#: neighbours do; where they don't, the earlier one stands.
AGAINST_CONVENTION = 1.75
_COST = {"dot_mdy": AGAINST_CONVENTION, "slash_dmy": AGAINST_CONVENTION}

PRAGUE = ZoneInfo("Europe/Prague")


@lru_cache(maxsize=20_000)
def _civil_offsets(y: int, m: int, d: int, h: int, zone: ZoneInfo) -> tuple[float, ...]:
    """Hours east of UTC that hold at this civil hour; two where clocks are put back."""
    both = [datetime(y, m, d, h, tzinfo=zone, fold=f).utcoffset().total_seconds() / 3600 for f in (0, 1)]
    return tuple(dict.fromkeys(both))


def _offsets(written: str | None, y: int, m: int, d: int, h: int, zone: ZoneInfo) -> tuple[float, ...]:
    if not written:
        out = _civil_offsets(y, m, d, h, zone)
        return out
    if written[0] in "+-":
        digits = written[1:].replace(":", "")
        hours, minutes = int(digits[:2]), int(digits[2:] or 0)
        if hours > 14 or minutes > 59:
            return ()
        return ((hours + minutes / 60) * (-1 if written[0] == "-" else 1),)
    return (ZONE_HOURS[z],) if (z := written.upper()) in ZONE_HOURS else ()


def _instant(moment: datetime) -> str:
    return moment.strftime("%Y-%m-%dT%H:%M:%SZ") if moment.year >= 1000 else ""


def readings(text: str | None, zone: ZoneInfo = PRAGUE) -> list[Reading]:
    """All valid interpretations of one written date, cheapest first, without repeats; none if it is unreadable."""
    out: dict[str, Reading] = {}
    text = " ".join((text or "").split())  # long runs of blanks cost the patterns nothing, so a text may have any length
    if not text:
        return []
    for form, shape in _SHAPES:
        if not (hit := shape.match(text)):
            continue
        g = hit.groupdict()
        cost = _COST.get(form, 0.0)
        try:
            if g.get("e") or g.get("ems"):
                seconds = int(g["e"]) if g.get("e") else int(g["ems"]) // 1000
                moment = datetime.fromtimestamp(seconds, timezone.utc)
                out.setdefault(n := _instant(moment), Reading(n, form, cost, float(seconds)))
                continue
            y = int(g["y"])
            y += 2000 if len(g["y"]) == 2 else 0
            if not FIRST_YEAR <= y <= LAST_YEAR:
                continue
            m = MONTH_OF.get(g["mon"].lower(), 0) if g.get("mon") else int(g["m"]) if g.get("m") else None
            d = int(g["d"]) if g.get("d") else None
            day = datetime(y, m or 1 if m is None else m, 1 if d is None else d)
            at = (day - datetime(1970, 1, 1)).total_seconds()
            if g.get("h") is None:
                n = f"{y:04d}" + (f"-{m:02d}" if m is not None else "") + (f"-{d:02d}" if d is not None else "")
                out.setdefault(n, Reading(n, form, cost, at))
                continue
            h, mi, s = int(g["h"]), int(g["mi"]), int(g["s"] or 0)
            next_day = h == 24 and not mi and not s
            local = day.replace(hour=0 if next_day else h, minute=mi, second=min(s, 59)) + timedelta(days=next_day)
            for hours in _offsets(g.get("z"), local.year, local.month, local.day, local.hour, zone):
                n = _instant(local - timedelta(hours=hours))
                out.setdefault(n, Reading(n, form, cost, at + h * 3600 + mi * 60 + s - hours * 3600))
        except ValueError:
            continue
    return sorted(out.values(), key=lambda r: (r.cost, r.at, r.normal))


def labelled(elements: list[str | None] | None) -> list[tuple[int, str]]:
    """The labelled dates of a field as (number through the whole field, written date), whatever their elements."""
    out: list[tuple[int, str]] = []
    for element in elements or []:
        hits = list(_LABEL.finditer(element or ""))
        for this, after in zip(hits, [*hits[1:], None]):
            written = element[this.end() : after.start() if after else len(element)]
            out.append((len(out) + 1, written.strip(" \t\r\n\xa0;/|,{}[]\"'")))
    return out
