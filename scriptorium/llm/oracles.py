"""DuckDB SQL of queries of this subpackage, written apart from the operators."""

from __future__ import annotations

_WS = r"\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_STAND_INS = (
    "", "-", "--", "–", "—", "?", "n/a", "na", "n.a.", "none", "null", "unknown", "not stated", "[s.n.]", "s.n.", "nezjištěno", "neuvedeno", "in press", "online first", "0",
)
_LINKING = ("of", "and", "the", "for", "in", "a", "und", "der", "die", "das", "für", "et", "de", "la", "le", "pro", "v")


def _listed(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


_JUDGED = f"""
with recursive e as (select dedup_kept_resource_id::bigint as a, dedup_other_resource_id::bigint as b from dedup_histoire union select dedup_other_resource_id::bigint, dedup_kept_resource_id::bigint from dedup_histoire),
reach as (select distinct a as node, a as r from e union select reach.node, e.b from reach join e on e.a = reach.r),
groups as (select node, min(r) as group_id from reach group by 1),
pubs as (select value, lower(trim(regexp_replace(value, '[{_WS}]+', ' ', 'g'))) as plain, count(*) as n from (select unnest(dc_publisher) as value from utb_metadata_arr) t where value is not null group by 1),
words as (select *, list_filter(string_split(regexp_replace(plain, '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+', ' ', 'g'), ' '), lambda w: w <> '' and w not in ({_listed(_LINKING)})) as ws from pubs),
short as (select distinct v.value from words v join words u on u.n >= v.n and u.plain <> v.plain
  where v.plain <> '' and (starts_with(u.plain, v.plain) or (len(v.ws) > 1 and len(v.ws) = len(u.ws) and v.ws <> u.ws and len(list_filter(v.ws, lambda w, i: not starts_with(u.ws[i], w))) = 0))),
good as (select value from pubs where plain not in ({_listed(_STAND_INS)}) and regexp_matches(plain, '\\p{{L}}{{2}}') and value not in (select value from short)),
m as (select g.group_id, r.resource_id, r.dc_publisher, r.utb_relation_volume as v, r.dc_date_accessioned[1] as seen from groups g join utb_metadata_arr r on r.resource_id = g.node)"""
_SURVIVORS = _JUDGED + """,
p as (select group_id, arg_max(resource_id, (seen, -resource_id)) as publisher_id from (select *, unnest(dc_publisher) as value from m) t where value in (select value from good) group by 1),
q as (select group_id, arg_max(resource_id, (seen, -resource_id)) as volume_id from m where try_cast(v as hugeint) > 0 group by 1)
select group_id, publisher_id, volume_id from (select distinct group_id from groups) t left join p using (group_id) left join q using (group_id)
"""

_VALUES = _JUDGED + """
select group_id, 'publisher' as field, value, count(distinct resource_id) as n_records from (select *, unnest(dc_publisher) as value from m) t where value in (select value from good) group by 1, 3
union all select group_id, 'volume', v, count(distinct resource_id) from m where try_cast(v as hugeint) > 0 group by 1, 3
"""

_REPETITION = """
with w as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{Nl}\\p{No}]+') as ws from documents),
g as (select doc_id, i, array_to_string(ws[i:i+7], ' ') as gram from (select doc_id, ws, unnest(range(1, len(ws) - 6)) as i from w) t),
r as (select doc_id, i from (select doc_id, i, min(i) over (partition by doc_id, gram) as first from g) t where i > first),
c as (select doc_id, count(distinct i + k) as covered from r, (select unnest(range(0, 8)) as k) t group by 1)
select doc_id from c join w using (doc_id) where covered >= 0.3 * len(ws)
"""


def sql() -> dict[str, str]:
    """Query name to SQL."""
    return {"p2_found": _SURVIVORS, "p2_values": _VALUES, "p10_found": _REPETITION}
