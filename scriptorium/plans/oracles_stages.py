"""DuckDB SQL of the stage queries (dates, Scopus blocks, authors, merges), written apart from the operators."""

from __future__ import annotations

from scriptorium.functions import fulltext_dates as vocabulary
from scriptorium.operators.affiliations import COUNTRIES, INSTITUTION_WORDS
from scriptorium.plans import oracles as base
from scriptorium.plans.oracles import _M, _match, _norm, _trim

_KINDS = {label: kind for kind, labels in vocabulary.LABELS.items() for label in labels}
_LABEL = "|".join(["[0-9](?:st|nd|rd|th)\\s+revision", *(r"\s+".join(label.split()) for label in sorted(_KINDS, key=len, reverse=True))])
_KIND_ROWS = ", ".join(f"('{label}', '{kind}')" for label, kind in _KINDS.items())
_MONTH_MAP = "map {" + ", ".join(f"'{name}': {number}" for name, number in vocabulary.MONTH_OF.items()) + "}"
_ORDER = ("received", "reviewed", "accepted", "published_online", "published")


def _day(y: str, m: str, d: str) -> str:
    return f"case when try_cast({y} as int) between 1990 and 2030 then try_cast({y} || '-' || lpad({m}::varchar, 2, '0') || '-' || lpad({d}::varchar, 2, '0') as date) end"


def _named(pattern: str, parts: str, day: bool) -> str:
    """Date of the first place of a pattern with a month's name."""
    got = f"regexp_extract(w, '(?i){pattern}', [{', '.join(repr(p) for p in parts)}])"
    month = f"{_MONTH_MAP}[lower({got}.m)]"
    return f"case when {got}.y <> '' and {month} is not null then {_day(f'{got}.y', month, f'{got}.d' if day else '1')} end"


_NTH = "(?:st|nd|rd|th)?"
_FIRST = lambda sign: "regexp_extract(w, '([0-9]{4})" + sign + "([0-9]{1,2})" + sign + "([0-9]{1,2})', ['y', 'm', 'd'])"
_EXACT = "coalesce(" + ", ".join((
    *(f"case when {_FIRST(s)}.y <> '' then {_day(f'{_FIRST(s)}.y', f'{_FIRST(s)}.m', f'{_FIRST(s)}.d')} end" for s in ("-", "[.]")),
    _named("([0-9]{1,2})" + _NTH + "\\s+of\\s+(\\p{L}+)[.]?\\s*,?\\s*([0-9]{4})", "dmy", True),
    _named("([0-9]{1,2})" + _NTH + "\\s+(\\p{L}+)[.]?\\s*,?\\s*([0-9]{4})", "dmy", True),
    _named("(\\p{L}+)[.]?\\s*,?\\s*([0-9]{1,2})" + _NTH + "\\s*,\\s*([0-9]{4})", "mdy", True),
)) + ")"
_MONTHLY = _named("(\\p{L}+)[.]?\\s*,?\\s*([0-9]{4})", "my", False)
_YEARLY = _day("nullif(regexp_extract(w, '(20[0-9]{2}|19[0-9]{2})', 1), '')", "'1'", "'1'")
_IN_ORDER = "list_filter([" + ", ".join(f"{{0}}_{k}" for k in range(5)) + "], lambda x: x is not null)"


def _firsts(value: str, name: str, where: str) -> str:
    return ", ".join(f"arg_min({value}, pos) filter (kind = '{k}' and {where}) as {name}_{i}" for i, k in enumerate(_ORDER))


_DATES = f"""
with src as (select resource_id, trim(regexp_replace(replace(regexp_replace(regexp_replace({_trim("coalesce(array_to_string(utb_fulltext_dates, ' '), '')")}, '^[{{"]+', ''), '["}}]+$', ''), '""', '"'), '[ \\n\\r\\t]+', ' ', 'g')) as x from {_M}),
marked as (select resource_id, x, string_split(regexp_replace(strip_accents(x), '\\b({_LABEL})\\b(?:\\s*:)?\\s*', chr(1) || '\\1' || chr(2), 'gi'), chr(1))[2:] as parts from src),
kinds as (select * from (values {_KIND_ROWS}) v(label, kind)),
cut as (select resource_id, string_split(p, chr(2))[1] as label, regexp_replace(trim(string_split(p, chr(2))[2]), '[.;,\\s]+$', '') as w, pos from (select resource_id, unnest(parts) as p, generate_subscripts(parts, 1) as pos from marked) t),
dots as (select c.resource_id, pos, w, case when regexp_full_match(lower(c.label), '[0-9](st|nd|rd|th)\\s+revision') then 'reviewed' else k.kind end as kind, regexp_extract(w, '([0-9]{{1,2}})[.]\\s*([0-9]{{1,2}})[.]\\s*([0-9]{{4}})', ['a', 'b', 'y']) as n
  from cut c left join kinds k on k.label = lower(regexp_replace(c.label, '\\s+', ' ', 'g'))),
both_ as (select *, try_cast(n.y as int) between 1990 and 2030 as dotted, {_day('n.y', 'n.b', 'n.a')} as dmy, {_day('n.y', 'n.a', 'n.b')} as mdy from dots),
open_ as (select resource_id, count(*) filter (dotted) as n_dotted, bool_or(dmy is null and mdy is null) filter (dotted) as has_bad, bool_or(dmy is not null and mdy is null) filter (dotted) as only_d, bool_or(mdy is not null and dmy is null) filter (dotted) as only_m,
  count(*) filter (dotted and dmy is not null and mdy is not null) as n_open, {_firsts('dmy', 'd', 'dotted and dmy is not null and mdy is not null')}, {_firsts('mdy', 'm', 'dotted and dmy is not null and mdy is not null')} from both_ group by 1),
fit as (select *, {_IN_ORDER.replace('{0}', 'd')} = list_sort({_IN_ORDER.replace('{0}', 'd')}) as fit_d, {_IN_ORDER.replace('{0}', 'm')} = list_sort({_IN_ORDER.replace('{0}', 'm')}) as fit_m from open_),
resolved as (select *, case when n_dotted = 0 or only_d and only_m then null when only_d then 'DMY' when only_m then 'MDY' when n_open < 2 then null when fit_d and not fit_m then 'DMY' when fit_m and not fit_d then 'MDY' end as fmt,
  case when n_dotted = 0 then null when only_d and only_m then 'invalid' when only_d or only_m then 'high' when n_open = 0 then 'invalid' when n_open = 1 then 'low' when fit_d and fit_m then 'low' when fit_d or fit_m then 'medium' else 'invalid' end as conf from fit),
read_ as (select b.*, r.fmt, contains(lower(w), '00th') or contains(lower(w), '20xx') or contains(lower(w), '0000') or regexp_matches(w, '&&\\s*&&') as placeholder,
  case when dotted then case when r.fmt = 'MDY' then coalesce(mdy, dmy) else coalesce(dmy, mdy) end when contains(w, '&&') then null else {_EXACT} end as exact, case when not coalesce(dotted, false) and not contains(w, '&&') then {_MONTHLY} end as monthly, case when not coalesce(dotted, false) and not contains(w, '&&') then {_YEARLY} end as yearly
  from both_ b join resolved r using (resource_id)),
got as (select *, case when placeholder then null else coalesce(exact, monthly, yearly) end as got, not placeholder and exact is null and monthly is not null as only_month from read_),
told as (select resource_id, {_firsts('got', 'g', 'got is not null')}, bool_or(placeholder) as has_placeholder, bool_or(not placeholder and got is null and regexp_matches(w, '[0-9]')) as unread, bool_or(only_month) as months, bool_or(kind = 'extra' and got is not null) as extras,
  count(*) filter (kind = 'received' and got is not null) > 1 as many_received, count(*) filter (kind = 'reviewed' and got is not null) > 1 as many_reviewed from got group by 1),
steps as (select *, {_IN_ORDER.replace('{0}', 'g')} as path from told),
back as (select *, list_max(list_transform(range(1, len(path)), lambda i: date_diff('day', path[i + 1], path[i]))) as worst from steps),
every_ as (select s.resource_id, s.x, len(m.parts) as n_parts, r.fmt, r.conf, r.has_bad, r.only_d and r.only_m as conflict, r.n_dotted > 0 and not coalesce(r.only_d, false) and not coalesce(r.only_m, false) and (r.n_open = 1 or r.n_open > 1 and fit_d and fit_m) as unclear, r.n_open > 1 and not coalesce(r.only_d, false) and not coalesce(r.only_m, false) and not fit_d and not fit_m as wrong_order, b.* exclude (resource_id),
  regexp_full_match(s.x, '[{{]?\\s*"?[0-9]{{4}}"?\\s*[}}]?') and try_cast(regexp_extract(s.x, '[0-9]{{4}}') as int) between 1990 and 2030 as one_year
  from src s join marked m using (resource_id) left join resolved r using (resource_id) left join back b using (resource_id)),
judged as (select *, coalesce(conf in ('low', 'invalid'), false) or coalesce(has_placeholder, false) or coalesce(unread, false) or coalesce(worst >= 30, false) as needs, len(path) > 0 as any_date from every_),
result as (select resource_id, {', '.join(f"case when x <> '' and not one_year then g_{i} end as {k}" for i, k in enumerate(_ORDER))},
  case when x = '' then 'empty' when one_year then 'year_only' when n_parts = 0 then 'no_labels' when needs then 'needs_llm' when any_date then 'processed' else 'no_dates' end as status,
  case when x = '' then false when one_year or n_parts = 0 then true else needs or not any_date end as needs_llm,
  case when x <> '' and not one_year then fmt end as mdr_format, case when x <> '' and not one_year then conf end as mdr_confidence,
  case when x = '' then '' when one_year then 'year_only_dates' when n_parts = 0 then 'no_labels_found|raw_text_preview' else array_to_string(list_sort(list_filter([
    case when has_bad then 'mdr_invalid_dates' end, case when conflict then 'mdr_format_conflict' end, case when unclear then 'mdr_ambiguous' end, case when wrong_order then 'mdr_chrono_error' end, case when has_placeholder then 'placeholder_dates' end, case when unread then 'unparseable_dates' end,
    case when months then 'month_year_only' end, case when extras then 'extra_dates' end, case when many_received then 'multiple_received' end, case when many_reviewed then 'multiple_reviewed' end, case when worst > 0 then 'chrono_warnings' end], lambda f: f is not null)), '|') end as flag_keys from judged)
"""

_COUNTRY = "|".join(c.lower().replace(".", "[.]") for c in sorted(COUNTRIES, key=len, reverse=True))
_INSTITUTION = "|".join(INSTITUTION_WORDS)
_INITIAL_FORM = "[A-Z]([.]?[A-Z])*[.]?"
_SCOPUS = f"""
se as (select resource_id, e, unnest(list_filter(list_transform(string_split(text, ';'), lambda p: {_trim("p")}), lambda p: p <> '')) as entry, generate_subscripts(list_filter(list_transform(string_split(text, ';'), lambda p: {_trim("p")}), lambda p: p <> ''), 1) as k
  from (select resource_id, unnest(utb_scopus_affiliation) as text, generate_subscripts(utb_scopus_affiliation, 1) - 1 as e from {_M}) t where text is not null),
sn as (select *, {_trim("string_split(entry, ',')[1]")} as l, {_trim("substr(entry, instr(entry, ',') + 1)")} as r from se),
sp as (select *, contains(entry, ',') and l <> '' and r <> '' and len(regexp_split_to_array(l, '\\s+')) <= 5 and not regexp_matches(lower(l), '(^|[^a-z0-9_])({_INSTITUTION})([^a-z0-9_]|$)') and regexp_full_match(regexp_split_to_array(l, '\\s+')[-1], '{_INITIAL_FORM}') as named from sn),
sc as (select *, regexp_replace(r, '([{base._WS}, ])({_COUNTRY})(\\s*(,|$))', '\\1\\2' || chr(1) || '\\3', 'gi') as m from sp),
sb as (select resource_id, e, k, case when named then l end as author, unnest(case when not named then [entry] when len(string_split(m, chr(1))) > 2 then list_filter(list_transform(string_split(m, chr(1)), lambda p: {_trim(f"regexp_replace(p, '^[,{base._WS}]+', '')")}), lambda p: p <> '') else [r] end) as affiliation,
  generate_subscripts(case when not named then [entry] when len(string_split(m, chr(1))) > 2 then list_filter(list_transform(string_split(m, chr(1)), lambda p: {_trim(f"regexp_replace(p, '^[,{base._WS}]+', '')")}), lambda p: p <> '') else [r] end, 1) as q from sc),
scopus as (select resource_id, e::bigint * 100000000 + (row_number() over (partition by resource_id, e order by k, q) - 1) * 10000 as pos, author, affiliation, {base._HOME} as is_home from sb)
"""


def _key(name: str) -> str:
    """Surname and initials of a name as one text."""
    w, l, r = (x.replace("name", name) for x in (base._WORDS, base._LEFT, base._RIGHT))
    return f"""case when contains({name}, ',') and len({l}) > 0 then array_to_string({l}, ' ') || '|' || {base._INITIALS.replace("{x}", r)}
    when contains({name}, ',') or len({w}) = 0 then {_norm(name)}
    when len({w}) > 1 and length(({w})[len({w})]) = 1 and length(({w})[1]) > 1 then ({w})[1] || '|' || {base._INITIALS.replace("{x}", f"({w})[2:]")}
    else ({w})[len({w})] || '|' || {base._INITIALS.replace("{x}", f"({w})[1:len({w})-1]")} end"""


_WOS_BLOCKS = f"""
wt as (select resource_id, e, text from (select resource_id, unnest(utb_wos_affiliation) as text, generate_subscripts(utb_wos_affiliation, 1) - 1 as e from {_M}) x where text is not null and {_trim("text")} <> ''),
wb as (select resource_id, e, unnest(regexp_extract_all(text, '{base._BLOCK}', 1)) as names, unnest(regexp_extract_all(text, '{base._BLOCK}', 2)) as place, generate_subscripts(regexp_extract_all(text, '{base._BLOCK}', 1), 1) - 1 as b from wt),
wc as (select resource_id, e::bigint * 100000000 + b * 10000 as pos, list_filter(list_transform(string_split(names, ';'), lambda a: {_trim("a")}), lambda a: a <> '') as authors, regexp_replace(place, '^[;{base._WS}]+|[;{base._WS}]+$', '', 'g') as affiliation from wb),
wos as (select *, {base._HOME} as is_home from (select resource_id, pos + generate_subscripts(case when len(authors) = 0 then [null] else authors end, 1) - 1 as pos, unnest(case when len(authors) = 0 then [null] else authors end) as author, affiliation from wc
  union all select resource_id, e::bigint * 100000000, null, {_trim("text")} from wt where len(regexp_extract_all(text, '{base._BLOCK}', 1)) = 0) t)"""
_BLOCKS = _WOS_BLOCKS + "," + _SCOPUS + ", blocks as (select 'wos' as source, * from wos union all select 'scopus', * from scopus)"

_HEAD = base._MATCHES[: base._MATCHES.index("found as (")]
_IDS = {"orcid": ("orcid", r"([0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{3}[0-9X])"), "scopus_id": ("scopusid", r"(?:^|[^0-9])([0-9]{8,11})(?:[^0-9]|$)"), "wos_id": ("wos_id", r"\b([A-Z]{1,3}-[0-9]{4}-[0-9]{4})\b")}
_BY_ID = " union all ".join(f"select n.name, {k}, '{kind}', min(a.author_id), 1.0 from names n join utb_authors a on a.{column} = nullif(regexp_extract(n.name, '{pattern}', 1), '') group by 1" for k, (kind, (column, pattern)) in enumerate(_IDS.items()))
_MATCH_ROWS = _HEAD + f"""found(name, stage, match_type, author_id, score) as (
  {_BY_ID}
  union all select name, 3, 'exact', min(author_id), 1.0 from names join written using (name) group by 1
  union all select n.name, 4, 'exact_normalized', min(author_id), 1.0 from names n join written w on n.norm = w.norm where n.norm <> '' group by 1
  union all select name, case when min(author_id) = max(author_id) then 5 else 6 end, case when min(author_id) = max(author_id) then 'initial_surname' else 'ambiguous_initials' end, case when min(author_id) = max(author_id) then min(author_id) end, case when min(author_id) = max(author_id) then 0.98 else 0.0 end from near where fits group by name
  union all select name, 7, 'ambiguous_surname', null, 0.0 from near where name in (select name from mine group by name having max(initials) = '') group by name having min(author_id) <> max(author_id)
  union all select name, 8, 'initial_mismatch', null, 0.0 from near group by name having max(initials <> '') and not max(fits)
  union all select name, 9, 'fuzzy', arg_max(author_id, (score, -author_id)), round(max(score), 4) from (select name, author_id, jaro_winkler_similarity(norm, their_norm) as score from near where initials = '' or fits) t where score >= 0.85 group by 1),
firsts as (select name, arg_min((author_id, match_type, score), stage) as x from found group by 1),
matches as (select n.name, x[1] as author_id, coalesce(x[2], 'none') as match_type, coalesce(x[3], 0.0)::double as score, x[1] is not null and (x[2] <> 'fuzzy' or x[3] >= 0.9) as matched from names n left join firsts using (name))"""
_PEOPLE = _MATCH_ROWS + f""",
listed as (select resource_id, unnest(dc_contributor_author) as name, generate_subscripts(dc_contributor_author, 1) - 1 as pos from {_M}),
people as (select resource_id, author_id, arg_min(name, pos) as name, min(pos)::int as pos from listed join (select name, author_id from matches where matched) m using (name) group by 1, 2)"""
_UNIT_LEVELS = f"""
u as (select * from {base._UNITS} t),
levels as (select u.id, u.name as unit, case when p.id is null then 0 else 1 end as level, coalesce(p.name, u.name) as faculty from u left join u p on p.id = u.parent_id)"""
_DEFAULTS = "defaults as (select author_id, min(f) as faculty, arg_max(o, (length(o), o)) as ou from (select a.author_id, coalesce(nullif(trim(a.faculty), ''), p.name) as f, case when u.parent_id is not null then u.name end as o from utb_authors a left join u on u.id = a.organization_id left join u p on p.id = u.parent_id) t group by 1)"
_ATTRIBUTION = _PEOPLE + "," + _BLOCKS + "," + _UNIT_LEVELS + f""", {_DEFAULTS},
home as (select distinct b.resource_id, p.author_id, b.source, unnest(list_concat([b.affiliation], regexp_split_to_array(b.affiliation, '\\s*[,;]\\s*'))) as text
  from (select *, {_key("author")} as key from blocks where is_home and author is not null) b join (select *, {_key("name")} as key from people) p on p.resource_id = b.resource_id and p.key = b.key),
texts as (select distinct text, {base._workplace("text")} as a from home),
nodes as (select id, {base._workplace("name")} as b from u),
near_nodes as (select text, id, length(b) as l, case when a = b then 1 when contains(a, b) or contains(b, a) then greatest(0.92, jaro_winkler_similarity(a, b)) else jaro_winkler_similarity(a, b) end as score from texts, nodes where a <> '' and b <> ''),
node_of as (select text, id, round(score, 4) as score from (select *, row_number() over (partition by text order by score desc, l desc, id) as k from near_nodes) z where k = 1 and score >= 0.92),
placed as (select resource_id, author_id, source, faculty, case when level > 0 then unit end as ou from (select h.resource_id, h.author_id, h.source, v.*, row_number() over (partition by h.resource_id, h.author_id, h.source order by n.score desc, v.level desc, length(v.unit) desc, v.id) as k from home h join node_of n using (text) join levels v using (id)) t where k = 1),
seen as (select resource_id, author_id, source, faculty, ou from (select *, row_number() over (partition by resource_id, author_id order by case when source = 'scopus' then 0 else 1 end, faculty, ou) as k from placed) t where k = 1),
rows_ as (select p.resource_id, p.author_id, p.pos, s.source, s.faculty as wf, s.ou as wo, s.resource_id is not null as has, d.faculty as df, d.ou as dou from people p left join seen s on s.resource_id = p.resource_id and s.author_id = p.author_id left join defaults d on d.author_id = p.author_id),
whole as (select resource_id, count(*) as n_people from rows_ group by 1),
tops as (select resource_id, wf as tf, wo as tou, n as tn from (select *, row_number() over (partition by resource_id order by n desc, first) as k from (select resource_id, wf, wo, count(*) as n, min(pos) as first from rows_ where has group by 1, 2, 3) q) t where k = 1),
cohort as (select r.*, n_people, tf, tou, tn / n_people as share, not has and coalesce(tn / n_people >= 0.8 and df = tf, false) as by_cohort from rows_ r join whole using (resource_id) left join tops using (resource_id)),
attributed as (select resource_id, author_id, case when has then wf when by_cohort then tf else df end as faculty, case when has then wo when by_cohort then tou else dou end as ou,
  case when has then 'verified_' || source when by_cohort then 'cohort' when df is not null then 'default' else 'unresolved' end as method,
  round(case when has then 1.0 when by_cohort then 0.85 * share when df is not null then 0.7 else 0.0 end, 4)::double as confidence, coalesce(has and df <> wf, false) as conflict from cohort)"""
_AMBIGUOUS = """
surnames as (select distinct author_id, surname from theirs),
firsts_of as (select surname, author_id from (select *, row_number() over (partition by surname order by author_id) as k from surnames) t where k <= 5),
meant as (select name, list_sort(list(distinct author_id))[1:5] as candidates from (select distinct name, surname from mine) m join firsts_of using (surname) group by 1),
open_names as (select l.resource_id, l.pos::int as pos, l.name, m.match_type, array_to_string(candidates, '|') as candidates from listed l join matches m using (name) join meant using (name) where m.match_type in ('ambiguous_initials', 'ambiguous_surname'))"""
_TRANSLATIONS = "(select alt_name as czech, canonical_name as english from canonical_ref where kind = 'faculty' and alt_name is not null)"


_SURVIVORS = base._CONTENT + f""", f as (select resource_id, pages, doctype = 'article' as article from ({base._COMPARABLE}) t),
x as (select l.*, case when match_type = 'early_access' and b.pages and not a.pages then id_b when match_type = 'merged_type' and b.article and not a.article then id_b else id_a end as special from links l join f a on a.resource_id = id_a join f b on b.resource_id = id_b),
y as (select id_a, id_b, match_type, score, case when match_type in ('early_access', 'merged_type') then special else least(id_a, id_b) end as kept_id from x),
chosen as (select *, case when kept_id = least(id_a, id_b) then greatest(id_a, id_b) else least(id_a, id_b) end as deleted_id from y)"""
_PLAN = _SURVIVORS.replace("with rows as", "with recursive rows as", 1) + """,
two_way as (select kept_id as a, deleted_id as b from chosen union select deleted_id, kept_id from chosen),
reach as (select a as node, a as r from two_way union select reach.node, e.b from reach join two_way e on e.a = reach.r),
component_of as (select node, min(r) as component from reach group by 1),
acts as (select component, kept_id as keep, deleted_id as gone, row_number() over (partition by component order by id_a, id_b, match_type) as n from chosen join component_of on node = kept_id),
fold as (
  select component, 0::bigint as n, [0::bigint] as old_ids, [0::bigint] as new_ids, null::bigint as k, null::bigint as d from (select distinct component from acts) t
  union all
  select component, n, case when d is null then old_ids else list_concat(list_filter(old_ids, lambda o: o <> d and o <> gone), [d, gone]) end,
    case when d is null then new_ids else list_concat(list_transform(list_filter(old_ids, lambda o: o <> d and o <> gone), lambda o: case when new_ids[list_position(old_ids, o)] = d then k else new_ids[list_position(old_ids, o)] end), [k, case when gone = k then gone else k end]) end, k, d
  from (select component, n, old_ids, new_ids, gone, case when kk = dd then null when dd <> gone and kk = keep then dd when dd <> gone then least(kk, dd) else kk end as k, case when kk = dd then null when dd <> gone and kk = keep then kk when dd <> gone then greatest(kk, dd) else dd end as d
    from (select f.component, a.n, f.old_ids, f.new_ids, a.keep, a.gone, coalesce(new_ids[list_position(old_ids, keep)], keep) as kk, coalesce(new_ids[list_position(old_ids, gone)], gone) as dd from fold f join acts a on a.component = f.component and a.n = f.n + 1) q) r),
plan as (select row_number() over (partition by component order by n) - 1 as seq, k as kept_id, d as deleted_id, component from fold where d is not null)"""
_MERGED = _PLAN + f""",
roots as (select distinct component, kept_id as root from plan where kept_id not in (select deleted_id from plan)),
members as (select c.node as resource_id, r.root, case when c.node = r.root then 0 else (select min(seq) + 1 from plan p where p.deleted_id = c.node) end as o from component_of c join roots r using (component) where c.node in (select kept_id from plan union select deleted_id from plan)),
"""


def _united(column: str) -> str:
    """Values of a column of all members of a merge in order, once each, for every record that is left."""
    return f"""u_{column} as (select root as resource_id, array_to_string(list(v order by o, resource_id, i), '||') as x from (
  select *, row_number() over (partition by root, {_norm("v")} order by o, resource_id, i) as k from (select m.root, m.o, m.resource_id, unnest(r.{column}) as v, generate_subscripts(r.{column}, 1) as i from members m join {_M} r using (resource_id)) t where {_trim("v")} <> '') z where k = 1 group by 1)"""


_FUZZY = f"""
with r as (select resource_id, {base._title(_trim("dc_title[1]"))} as title, coalesce(try_cast(nullif(regexp_extract(dc_date_issued[1], '\\b((?:19|20)\\d{{2}})\\b', 1), '') as int), -1) as year,
  coalesce(lower(regexp_replace(dc_identifier_issn[1], '[^0-9xX]', '', 'g')), '') as issn, coalesce(lower(regexp_replace(dc_identifier_isbn[1], '[^0-9xX]', '', 'g')), '') as isbn from {_M}),
c as (select title, year, issn, isbn, min(resource_id) as rep, count(*) as n from r where title <> '' group by 1, 2, 3, 4),
p as (select a.rep as id_a, b.rep as id_b, a.issn <> '' and a.issn = b.issn as same_issn, a.isbn <> '' and a.isbn = b.isbn as same_isbn, {base.similarity("a.title", "b.title")} as score from c a join c b on a.rep < b.rep and (a.year = b.year or a.year >= 0 and b.year >= 0 and abs(a.year - b.year) <= 1))
select id_a, id_b, case when same_issn then 'fuzzy_title+issn' when same_isbn then 'fuzzy_title+isbn' else 'fuzzy_title' end as match_type, round(score, 4) as score from p where score >= 0.85
union all select rep, resource_id, case when issn <> '' then 'fuzzy_title+issn' when isbn <> '' then 'fuzzy_title+isbn' else 'fuzzy_title' end, 1.0 from r join c using (title, year, issn, isbn) where n > 1 and resource_id <> rep
"""


def _fixes() -> str:
    """Suggested fixes of all text fields and DOIs."""
    parts = []
    for f in base._TEXT_FIELDS:
        sql, at = f"select resource_id, x as s0, i from (select resource_id, unnest({f}) as x, generate_subscripts({f}, 1) as i from {_M}) t", 0
        for _, expr in base._FIX:
            sql, at = f"select *, {expr.replace('{x}', f's{at}')} as s{at + 1} from ({sql}) t{at}", at + 1
        sql = f"select *, {_trim(f's{at}')} as s{at + 1} from ({sql}) t{at}"
        kinds = [(k, f"bool_or(s{n + 1} <> s{n})") for n, k in enumerate([*(k for k, _ in base._FIX), "trailing_spaces"])]
        told = ", ".join(f"case when {test} then '{k}' end" for k, test in sorted(kinds))
        parts.append(f"select resource_id, '{f}' as field_name, array_to_string(list(s{at + 1} order by i), '||') as suggested, array_to_string(list_filter([{told}], lambda k: k is not null), '+') as fix_type from ({sql}) z group by 1 having bool_or(s{at + 1} is distinct from s0)")
    form = "10\\.[0-9]{4,9}/[-._;()/:A-Za-z0-9]+"
    parts.append(f"""select resource_id, 'dc_identifier_doi', array_to_string(list(c order by i), '||'), 'doi' from (select *, {base._CLEAN_DOI} as c from (select resource_id, unnest(dc_identifier_doi) as x, generate_subscripts(dc_identifier_doi, 1) as i from {_M}) t) u
      group by 1 having bool_or(coalesce({_trim("x")}, '') <> '' and not regexp_full_match(x, '{form}') and regexp_full_match(c, '{form}')) and bool_or(c is distinct from x)""")
    return " union all ".join(parts)


_CLEAN = base._CLEAN_DOI
_LOOKUPS = f"""
{base._GROUPS},
ids as (select resource_id, list_filter(list_transform(coalesce(dc_identifier_doi, []), lambda x: lower({_CLEAN})), lambda x: x <> '') as doi, {base._ordered_distinct(f"({base._ISSNS})")} as issn, {base._ordered_distinct(f"({base._ISBNS})")} as isbn from {_M}),
flat as (select resource_id, id_kind, group_id, 'doi' as key_kind, 0 as step, unnest(doi) as key, generate_subscripts(doi, 1) as place from groups join ids using (resource_id) where group_id is not null
  union all select resource_id, id_kind, group_id, 'issn', 1, unnest(issn), generate_subscripts(issn, 1) from groups join ids using (resource_id) where id_kind = 'issn'
  union all select resource_id, id_kind, group_id, 'isbn', 1, unnest(isbn), generate_subscripts(isbn, 1) from groups join ids using (resource_id) where id_kind = 'isbn'),
once as (select id_kind, group_id, key_kind, step, key, min((resource_id, place)) as pos from flat group by all),
providers as (select * from (values ('issn', 'doi', 'crossref', 0), ('issn', 'issn', 'crossref', 0), ('issn', 'issn', 'openalex', 1), ('isbn', 'doi', 'crossref', 0), ('isbn', 'isbn', 'google', 0), ('isbn', 'isbn', 'openlibrary', 1)) v(id_kind, key_kind, provider, rank)),
keys as (select * from once join providers using (id_kind, key_kind)),
told as (select 'crossref' as provider, lower({_CLEAN}) as key, dc_publisher[1] as publisher, case when resource_id % 2 = 0 then dc_relation_ispartof[1] end as journal from (select *, dc_identifier_doi[1] as x from {_M}) m where resource_id % 3 = 0
  union all select 'openalex', unnest({base._ordered_distinct(f"({base._ISSNS})")}), dc_publisher[1], case when resource_id % 2 = 0 then dc_relation_ispartof[1] end from {_M} where resource_id % 3 = 0),
answers as (select provider, key, nullif({_trim("min(publisher)")}, '') as publisher, nullif({_trim("min(journal)")}, '') as journal from told where key <> '' group by 1, 2),
good as (select * from answers where journal is not null or publisher is not null and provider = 'crossref'),
looked as (select id_kind, group_id, publisher, journal, provider from (select *, row_number() over (partition by id_kind, group_id order by step, pos, rank) as k from keys join good using (provider, key)) t where k = 1)"""
_LOOKED_PROPOSALS = base._PROPOSALS.replace(base._GROUPS, _LOOKUPS.strip(), 1).replace("proposals as (", "canon_looked as (select c.id_kind, c.group_id, coalesce(l.publisher, p) as p, coalesce(l.journal, j) as j from canon c left join looked l using (id_kind, group_id)),\nproposals as (", 1).replace("left join canon c on", "left join canon_looked c on")
_LISTED = f"(select resource_id, dc_title[1] as title, dc_date_issued[1] as issued, array_to_string(dc_contributor_author, '||') as names, dc_relation_ispartof[1] as journal, lower(dc_identifier_doi[1]) as dup_key from {_M})"
_PENDING_OLD = base._PENDING.replace("target_table, new_value from", "target_table, new_value, old_value from")


def _small() -> dict[str, str]:
    """SQL of the queries over one step each."""
    blank = lambda c: f"coalesce({_trim(c)}, '') = ''"
    shown = " union all ".join(f"select resource_id, '{k}' as field_key, array_to_string({c}, '||') as value from {_M}" for k, c in base._SHOWN.items())
    overlay = f"select s.resource_id, s.field_key, case when p.id is not null and p.new_value is not null then p.new_value else s.value end as shown from ({shown}) s left join (select * from ({base._PENDING}) q where target_table = '{_M}') p using (resource_id, field_key)"
    approved = lambda key, column: f"case when resource_id % 2 = 0 and p_{column}.v is not null then array_to_string(list_filter(list_transform(regexp_split_to_array(p_{column}.v, '\\s*\\|\\|\\s*'), lambda x: {_trim('x')}), lambda x: x <> ''), '||') else array_to_string({column}, '||') end"
    pivot = lambda key, column: f"left join (select resource_id, new_value as v from ({base._PENDING}) q where target_table = '{_M}' and field_key = '{key}') p_{column} using (resource_id)"
    edited = {"dc.publisher": ("dc_publisher", "publisher"), "dc.contributor.author": ("dc_contributor_author", "names"), "utb.ou": ("utb_ou", "ou")}
    iso = lambda t: f"case when regexp_full_match({t}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') then try_cast({t} as date) when regexp_full_match({t}, '[0-9]{{8}}') then try_cast({t}[1:4] || '-' || {t}[5:6] || '-' || {t}[7:8] as date) end"
    told = lambda t: f"case when resource_id % 10 < 2 then null when coalesce(year({iso(t)}) between 1990 and 2035, false) and not ({t} like '%-01-01' and coalesce(raw, '') <> '' and not regexp_matches(raw, '(?i)\\b0?1[.\\-/ ]|jan')) then {t} else '' end"
    parts = f"list_filter(list_transform(string_split(affiliation, ','), lambda p: {_trim('p')}), lambda p: p <> '')"
    types = "('id', 'bigint', false), ('resource_id', 'bigint', true), ('field_key', 'string', true), ('target_table', 'string', true), ('old_value', 'string', true), ('new_value', 'string', true), ('created_at', 'timestamp', true), ('approved_at', 'timestamp', true), ('discarded_at', 'timestamp', true), ('tags', 'array<string>', true), ('sizes', 'array<int>', true)"
    return {
        "validation_registry": f"select resource_id, array_to_string(list_sort(list(distinct name)), '||') as names from (select resource_id, unnest(utb_contributor_internalauthor) as name from {_M}) t where name is not null and name not in (select unnest(string_split(display_name, '||')) from utb_authors where display_name is not null) group by 1",
        "url_fixes": f"select resource_id, array_to_string(list(c order by i), '||') as suggested from (select resource_id, i, x, string_split(x, '?')[1] as c from (select resource_id, unnest(dc_identifier_doi) as x, generate_subscripts(dc_identifier_doi, 1) as i from {_M}) t) u group by 1 having bool_or(c is distinct from x)",
        "validation_due": f"select resource_id from {_M} where resource_id % 3 <> 0",
        "validation_again": f"with fixed as (select distinct resource_id from ({_fixes()}) f), bad as (select distinct resource_id from ({base._rules()}) r) select m.resource_id, case when f.resource_id is not null then 'not_checked' when b.resource_id is not null then 'has_issues' else 'ok' end as status from {_M} m left join fixed f using (resource_id) left join bad b using (resource_id)",
        "records_fetched": f"select resource_id, len(dc_title)::int as n_titles from {_M} where resource_id in (select resource_id from llm_author_entry)",
        "records_first_page": f"select resource_id from {_M} order by 1 limit 500",
        "records_smallest_page": f"select resource_id from {_M} order by 1 limit 1",
        "units_valid": f"select id, name from {base._UNITS} u where id % 4 <> 0 or id > 110",
        "journal_lookup_keys": f"with {_LOOKUPS} select id_kind, group_id, key_kind, provider, key, step, rank from keys",
        "journal_lookups": f"with {_LOOKUPS} select * from looked",
        "journal_proposals_looked_up": _LOOKED_PROPOSALS + "select * from proposals",
        "journal_applied": base._PROPOSALS + "select case when status = 'has_proposal' and group_id < '5' then 'applied' else status end as status, count(*) as n from proposals group by 1",
        "journal_statuses_set": base._PROPOSALS + "select case when resource_id % 5 = 0 then 'error' else status end as status, count(*) as n from proposals group by 1",
        "journal_records_applied": base._PROPOSALS + f"select resource_id, coalesce(proposed_publisher, array_to_string(dc_publisher, '||')) as publisher, coalesce(proposed_journal, array_to_string(dc_relation_ispartof, '||')) as journal from {_M} join proposals using (resource_id)",
        "journal_limited": base._PROPOSALS + "select group_id, count(*) as n from proposals where group_id is null or group_id in (select distinct group_id from proposals where group_id is not null order by 1 limit 20) group by 1",
        "record_page": f"select resource_id, issued from {_LISTED} t order by issued desc nulls last, resource_id limit 200",
        "record_page_grouped": f"select resource_id, title from {_LISTED} t order by coalesce(dup_key, '~' || resource_id::varchar), title nulls last, resource_id limit 200",
        "record_relevance": f"select resource_id, score from (select resource_id, (coalesce(contains(lower(title), 'polymer'), false)::int * 2 + coalesce(contains(lower(names), 'polymer'), false)::int + coalesce(contains(lower(journal), 'polymer'), false)::int) as score from {_LISTED} t) u where score > 0",
        "author_candidates": f"select resource_id, name, score, rank from (select *, row_number() over (partition by resource_id order by score desc, name nulls first)::int as rank from (select distinct resource_id, name, (case when contains(name, ',') then length(name) % 7 else 0 end)::int as score from (select resource_id, unnest(dc_contributor_author) as name from {_M}) t) u) v where score > 0 and rank <= 3 or rank <= 2",
        "field_rows": f"select resource_id, field_key, row_number() over (partition by resource_id order by place = 0, place, blank, field_key)::int as row from (select *, coalesce(list_position(['dc.title', 'utb.ou', 'dc.publisher'], field_key), 0) as place, coalesce(shown, '') = '' as blank from ({overlay}) o where resource_id % 4 = 0) t",
        "changes_saved": f"""with p as (select * from ({_PENDING_OLD}) q where id % 3 = 0), change as (select resource_id, field_key, case when id % 2 = 0 then old_value else new_value || '!' end as v from p),
            back as (select distinct c.resource_id, c.field_key from change c join (select distinct resource_id, field_key, old_value from p) b on b.resource_id = c.resource_id and b.field_key = c.field_key where c.v is not distinct from b.old_value),
            saved as (select e.resource_id, case when approved_at is not null then 'approved' when discarded_at is not null or b.resource_id is not null then 'discarded' else 'pending' end as state from (select distinct * from utb_change_buffer) e left join back b on b.resource_id = e.resource_id and b.field_key = e.field_key
              union all select c.resource_id, 'pending' from change c left join back b on b.resource_id = c.resource_id and b.field_key = c.field_key where b.resource_id is null)
            select resource_id, state, count(*) as n from saved group by 1, 2""",
        "changes_approved": f"select resource_id, {', '.join(f'{approved(k, c)} as {n}' for k, (c, n) in edited.items())} from {_M} m {' '.join(pivot(k, c) for k, (c, _) in edited.items())}",
        "records_checked": f"select resource_id in (select resource_id from dedup_histoire) as is_checked, count(*) as n from {_M} group by 1",
        "duplicate_matches": base._CONTENT + "select id_a as resource_id, id_b as other, match_type, score from links union select id_b, id_a, match_type, score from links",
        "values_proposed": f"select resource_id, entry_pos, case when not {blank('ou')} then ou when not {blank('faculty')} then faculty end as proposed, case when not {blank('ou')} then 'llm' when not {blank('faculty')} then 'heuristic' end as proposed_by from llm_author_entry",
        "display_values": f"select resource_id, shown, len(list_filter(list_transform(regexp_split_to_array(shown, '\\s*\\|\\|\\s*'), lambda x: {_trim('x')}), lambda x: x <> ''))::int as n from (select resource_id, array_to_string(dc_contributor_author, '||') as shown from {_M}) t where shown is not null",
        "jats_stripped": f"""select resource_id, {_trim("regexp_replace('<jats:p>' || dc_description_abstract[1] || ' </jats:p>', '(?i)</?jats:[^>]*>', '', 'g')")} as text from {_M} where dc_description_abstract[1] is not null""",
        "external_ids": "select author_id, poradie, t, nullif(regexp_extract(t, '([0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{3}[0-9X])', 1), '') as orcid, nullif(regexp_extract(t, '(?:^|[^0-9])([0-9]{8,11})(?:[^0-9]|$)', 1), '') as scopus, nullif(regexp_extract(t, '\\b([A-Z]{1,3}-[0-9]{4}-[0-9]{4})\\b', 1), '') as wos from (select distinct author_id, poradie, concat_ws(' ', display_name, orcid, 'id ' || scopusid, wos_id) as t from utb_authors) u",
        "json_migrated": "select distinct resource_id, dedup_other_resource_id, case when resource_id % 3 = 0 then '{\"raw\":\"' || coalesce(dedup_match_type, '') || '\"}' when resource_id % 3 = 1 then coalesce(dedup_match_details, '{}') else '{}' end as details from dedup_histoire",
        "legacy_columns": f"select resource_id, author_flags, len(utb_faculty)::int as author_faculty from {_M}",
        "increments": f"select resource_id, count(*) as n from (select resource_id from {_M} union all select resource_id from dedup_histoire) t group by 1",
        "columns_synced": f"select dedup_match_type, no_volume, count(*) as n from (select null::varchar as dedup_match_type, utb_relation_volume is null as no_volume from {_M} union all select dedup_match_type, true from dedup_histoire) t group by 1, 2",
        "bootstrap_rows": "select field_key, count(distinct id) as n from utb_change_buffer group by 1",
        "typed_columns": f"select * from (values {types}) v(name, spark_type, nullable)",
        "salvaged_answers": "select distinct dedup_match_details, json_extract_string(dedup_match_details, '$.by') as basis from dedup_histoire",
        "authors_completed": f"""with e as (select resource_id, entry_pos, {_trim("name")} as name, coalesce({_trim("faculty")}, '') as faculty, coalesce({_trim("ou")}, '') as ou, lower({base._squeeze("name")}) as key from llm_author_entry where name is not null),
            c as (select resource_id, lower({base._squeeze("name")}) as key, max(name) as preferred from llm_author_entry where name is not null and entry_pos % 2 = 1 group by 1, 2),
            f as (select *, row_number() over (partition by resource_id, key order by entry_pos) as k from e join c using (resource_id, key)),
            bad as (select distinct resource_id from e where length(name) < 3), faculties as (select distinct canonical_name from canonical_ref where kind = 'faculty'),
            pairs as (select o.ou, r.canonical_name as unit, r.ref_id, {base.similarity("lower(r.canonical_name)", "lower(o.ou)")} as score from (select distinct ou from f where ou <> '') o, canonical_ref r where r.kind = 'ou'),
            snapped as (select ou, unit from (select *, row_number() over (partition by ou order by score desc, ref_id) as k from pairs) t where k = 1 and score >= 0.92),
            g as (select f.resource_id, f.entry_pos, f.preferred, case when f.faculty in (select * from faculties) then f.faculty else '' end as faculty, coalesce(s.unit, '') as unit from f left join snapped s using (ou) where k = 1)
            select a.resource_id, case when b.resource_id is null then 'processed' else 'validation_error' end as status, case when b.resource_id is null then coalesce(names, '') end as names, case when b.resource_id is null then coalesce(faculties, '') end as faculties, case when b.resource_id is null then coalesce(ous, '') end as ous
            from (select distinct resource_id from e) a left join bad b using (resource_id) left join (select resource_id, array_to_string(list(preferred order by entry_pos), '||') as names, array_to_string(list(faculty order by entry_pos), '||') as faculties, array_to_string(list(unit order by entry_pos), '||') as ous from g group by 1) h using (resource_id)""",
        "dates_completed": f"select resource_id, case when resource_id % 10 < 2 then 'validation_error' else 'processed' end as status, {told('a')} as accepted, {told('p')} as published from (select resource_id, array_to_string(utb_fulltext_dates, ' ') as raw, coalesce({_trim('dc_date_accessioned[1][1:10]')}, '') as a, coalesce({_trim('dc_date_issued[1]')}, '') as p from {_M}) t",
        "prompts": f"select resource_id, concat_ws(chr(10), 'Return a JSON object with the key authors: a list of objects with name, faculty and ou. Use only the candidates.', 'Record ' || resource_id, 'Authors: ' || array_to_string(coalesce(dc_contributor_author, []), '; '), 'Affiliations: ' || array_to_string(coalesce(utb_wos_affiliation, []), '; '), 'Candidates: ' || array_to_string(coalesce(utb_contributor_internalauthor, []), '; ')) as prompt from {_M}",
        "crossref_details": f"""select resource_id, case when resource_id % 2 = 0 then y || '-' || m || '-' || lpad(d::varchar, 2, '0') when resource_id % 3 = 0 then y || '-' || m else y end as dc_date_issued, case when resource_id % 3 = 0 then y || '-' || m end as dc_date_available,
            nullif({_trim("dc_publisher[1] || case when len(dc_type) > 0 then ' (' || array_to_string(dc_type, ', ') || ')' else '' end")}, '') as funders, nullif({_trim("dc_identifier_doi[1]")}, '') as dc_rights_uri, dc_identifier_issn[1] || ' (print)' as issn_types, dc_identifier_doi[1] as dc_identifier_uri, case when instr(page, '-') > 0 then substr(page, instr(page, '-') + 1) end as dc_citation_epage
            from (select *, (resource_id % 30 + 1990)::varchar as y, lpad(((resource_id % 28 + 1) % 12 + 1)::varchar, 2, '0') as m, resource_id % 28 + 1 as d, concat_ws('-', dc_citation_spage[1], dc_citation_epage[1]) as page from {_M}) t""",
        "scopus_parts": f"with {_SCOPUS} select affiliation, p[1] as department, p[2] as faculty, list_filter(p, lambda x: regexp_matches(x, '(?i)univ|institute of|academy|college'))[1] as institution from (select distinct affiliation, {parts} as p from scopus) t",
    }


def sql() -> dict[str, str]:
    """Query name to SQL."""
    return {
        "date_extraction": _DATES + "select * from result",
        "date_status": _DATES + "select status, count(*) as n, count(received) as n_received, count(accepted) as n_accepted, count(published) as n_published, sum(needs_llm::int)::bigint as n_needs_llm from result group by 1",
        "dedup_fuzzy_links": _FUZZY,
        "dedup_merge_plan": _PLAN + "select * from plan",
        "dedup_merged_records": _MERGED + _united("dc_contributor_author") + "," + _united("utb_source") + f""" select m.resource_id, coalesce(nullif(a.x, ''), array_to_string(m.dc_contributor_author, '||')) as names, coalesce(nullif(b.x, ''), array_to_string(m.utb_source, '||')) as sources
            from {_M} m left join u_dc_contributor_author a using (resource_id) left join u_utb_source b using (resource_id) where m.resource_id not in (select deleted_id from plan)""",
        "dedup_history": _PLAN + f"select x.id as resource_id, kept_id as dedup_kept_resource_id, deleted_id as dedup_other_resource_id, (select count(*) from {_M} m where m.resource_id = x.id) as copies from (select *, unnest([kept_id, deleted_id]) as id from plan) x",
        "validation_fixes": _fixes(),
        "author_matches": _MATCH_ROWS + "select * from matches",
        "preferred_names": _PEOPLE + "select resource_id, 'id:' || author_id as identity, name, pos from people",
        "ambiguous_authors": _PEOPLE + "," + _AMBIGUOUS + "select * from open_names",
        "attribution": _ATTRIBUTION + "select * from attributed",
        "author_records": _ATTRIBUTION + "," + _AMBIGUOUS + f""", payload as (select p.resource_id, array_to_string(list(p.name order by pos, p.name, coalesce(faculty, ''), coalesce(ou, '')), '||') as names, array_to_string(list(coalesce(faculty, '') order by pos, p.name, coalesce(faculty, ''), coalesce(ou, '')), '||') as faculties, array_to_string(list(coalesce(ou, '') order by pos, p.name, coalesce(faculty, ''), coalesce(ou, '')), '||') as ous, count(*) filter (conflict) as n_conflicts, count(*) filter (method = 'unresolved') as n_unresolved from people p join attributed using (resource_id, author_id) group by 1),
            unsure as (select resource_id, count(*) as n_ambiguous from open_names group by 1), wos_texts as (select resource_id, min((coalesce({_trim("text")}, '') <> '')::int) = 1 as wos_ok from (select resource_id, unnest(utb_wos_affiliation) as text from {_M}) t group by 1)
            select m.resource_id, names, faculties, ous, coalesce(n_conflicts, 0) as n_conflicts, coalesce(n_unresolved, 0) as n_unresolved, coalesce(n_ambiguous, 0) as n_ambiguous, coalesce(wos_ok, true) as wos_ok, json_extract_string(author_flags, '$.duplicates') as duplicates, not coalesce(wos_ok, true) or coalesce(n_unresolved, 0) > 0 or coalesce(n_ambiguous, 0) > 0 as needs_llm
            from {_M} m left join payload using (resource_id) left join unsure using (resource_id) left join wos_texts using (resource_id)""",
        "aligned_affiliations": f"with {_BLOCKS}, mine as (select resource_id, name, (pos)::int as pos, {_key('name')} as key from (select resource_id, unnest(dc_contributor_author) as name, generate_subscripts(dc_contributor_author, 1) - 1 as pos from {_M}) t), f as (select resource_id, {_key('author')} as key, source, arg_min(affiliation, (pos, affiliation)) as affiliation from blocks where author is not null group by all) select resource_id, pos, name, source, affiliation from mine join f using (resource_id, key)",
        "author_inputs": f"""with {_BLOCKS}, t as (select resource_id, coalesce(len(list_filter(utb_source, lambda x: regexp_matches(lower(x), 'wos|wok'))) > 0, false) as w, coalesce(len(list_filter(utb_source, lambda x: contains(lower(x), 'scopus'))) > 0, false) as s, unnest(dc_contributor_author) as name, generate_subscripts(dc_contributor_author, 1) - 1 as pos from {_M}),
            hr as (select distinct on (resource_id, dedup_kept_resource_id) dedup_kept_resource_id::bigint as kept, utb_source, dc_contributor_author from dedup_histoire where resource_id <> dedup_kept_resource_id),
            h as (select kept as resource_id, coalesce(len(list_filter(utb_source, lambda x: regexp_matches(lower(x), 'wos|wok'))) > 0, false) as w, coalesce(len(list_filter(utb_source, lambda x: contains(lower(x), 'scopus'))) > 0, false) as s, unnest(dc_contributor_author) as name, generate_subscripts(dc_contributor_author, 1) - 1 as pos from hr),
            o as (select * from h union all select * from t where w <> s and resource_id not in (select resource_id from h)),
            lists as (select resource_id, pos, name from o where w union all select resource_id, pos + 1000000000, name from o where s union all select resource_id, pos + 2000000000, name from t
              union all select resource_id, pos + 1000000000000000, name from o where w union all select resource_id, pos + 2000000000000000, name from o where s
              union all select resource_id, case when source = 'scopus' then 3000000000000000 else 4000000000000000 end + pos, author from blocks where author is not null),
            k as (select *, {_key("name")} as key, {base._WORDS} as w from lists where {_trim("name")} <> ''),
            b as (select resource_id, key, min(pos) as first, arg_max(name, (contains(name, ',')::int, len(list_filter(w, lambda x: length(x) > 1)), length(regexp_replace(name, '[\\x00-\\x7F]', '', 'g')), length(name), -pos)) as name from k group by all)
            select resource_id, array_to_string(list(name order by first), '||') as names from b group by 1""",
        "registry_surnames": f"""select distinct author_id, poradie, case when bare and contains(shown, ',') then {_trim("string_split(shown, ',')[1]")} else surname end as surname, case when bare and contains(shown, ',') then nullif({_trim("substr(shown, instr(shown, ',') + 1)")}, '') else given_name end as given_name from (select *, string_split(display_name, '||')[1] as shown, coalesce({_trim("surname")}, '') = '' as bare from utb_authors) t""",
        "english_units": f"with t as (select {_norm('czech')} as key, min(english) as english from {_TRANSLATIONS} x group by 1) select ref_id as id, coalesce(case when ref_id % 3 <> 0 then canonical_name end, t.english) as name from canonical_ref r left join t on t.key = {_norm('r.alt_name')} where kind in ('faculty', 'ou')",
        "person_data": f"""with u as (select * from {base._UNITS} t), names as (select key, min(faculty) as faculty from (select {_norm('name')} as key, name as faculty from u where parent_id is null union all select {_norm('czech')}, english from {_TRANSLATIONS} x where english in (select name from u where parent_id is null)) k group by 1),
            told as (select author_id, list_sort(list(distinct n.faculty)) as fs from (select author_id, unnest(regexp_split_to_array(faculty, '\\s*\\|\\|\\s*')) as x from utb_authors) a join names n on n.key = {_norm('a.x')} and trim(a.x) <> '' group by 1),
            units as (select a.author_id, arg_max(u.name, (length(u.name), u.name)) as ou from utb_authors a join u on u.id = a.organization_id where u.parent_id is not null group by 1)
            select author_id, coalesce(array_to_string(fs, '||'), '') as faculties, ou from (select distinct author_id from utb_authors) e left join told using (author_id) left join units using (author_id)""",
        "scopus_blocks": f"with {_SCOPUS} select resource_id, author, affiliation, is_home from scopus",
    } | _small()
