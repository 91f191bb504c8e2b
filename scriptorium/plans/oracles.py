"""DuckDB SQL of the core queries, written apart from the operators."""

from __future__ import annotations

from scriptorium.settings import Settings

# White space as Unicode has it; the SQL engine's own class is ASCII only.
_WS = r"\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_M = "utb_metadata_arr"
_PUNCT = r"[\x{2010}-\x{2015}\x{2212}\-_.,;:!?()\[\]{}\"''`\x{2018}-\x{201F}\x{00AB}\x{00BB}/\\]"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"


def _squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{_WS}]+', ' ', 'g'))"


def _norm(x: str) -> str:
    return f"coalesce({_squeeze(f'strip_accents(lower({x}))')}, '')"


def _match(x: str) -> str:
    inner = f"regexp_replace({_norm(x)}, '[^\\p{{L}}\\p{{M}}\\p{{N}}_{_WS}]', ' ', 'g')"
    return _squeeze(inner)


def _title(x: str) -> str:
    return f"coalesce({_squeeze(f"regexp_replace(strip_accents(lower({x})), '{_PUNCT}', ' ', 'g')")}, '')"


def _split_ids(column: str) -> str:
    return f"list_filter(flatten(list_transform({column}, lambda x: string_split(x, ','))), lambda p: p is not null)"


_ISSNS = f"list_filter(list_transform({_split_ids('dc_identifier_issn')}, lambda p: lower({_trim('p')})), lambda p: length(p) = 9 and substr(p, 5, 1) = '-')"
_ISBNS = f"list_filter(list_transform({_split_ids('dc_identifier_isbn')}, lambda p: regexp_replace(p, '[-{_WS}]', '', 'g')), lambda p: regexp_full_match(p, '([0-9]{{9}}|[0-9]{{12}}).'))"


def _ordered_distinct(x: str) -> str:
    return f"list_filter({x}, lambda p, i: list_position({x}, p) = i)"


_TEXT_FIELDS = ("dc_title", "dc_description_abstract", "dc_contributor_author", "utb_wos_affiliation", "utb_scopus_affiliation", "dc_publisher", "dc_relation_ispartof")
_TESTS = {
    "trailing_spaces": f"^[{_WS}]|[{_WS}]$",
    "mojibake": r"\x{fffd}|\x{c3}[\x{80}-\x{ff}]|\x{e2}\x{80}[^\s]",
    "encoding_chars": r"[\x{e09d}\x{e104}\x{e103}\x{100}\x{11c}\x{124}\x{bc5}\x{131}]",
    "standalone_diacritics": r"[\x{2c7}\x{2dd}\x{2da}\x{301}\x{b4}\x{2d8}\x{308}\x{a8}\x{2c6}]",
    "nbsp": r"[\x{a0}\x{202f}\x{2007}]",
    "double_space": " {2,}",
}


def _rules() -> str:
    parts = []
    for rule, test in _TESTS.items():
        hit = " or ".join(f"len(list_filter({f}, lambda x: regexp_matches(x, '{test}'))) > 0" for f in _TEXT_FIELDS)
        parts.append(f"select resource_id, '{rule}' as rule from {_M} where {hit}")
    parts.append(f"select resource_id, 'pipe_in_field' from {_M} where len(list_filter(utb_wos_affiliation, lambda x: contains(x, '|'))) > 0 or len(list_filter(utb_scopus_affiliation, lambda x: contains(x, '|'))) > 0")
    parts.append(f"select resource_id, 'invalid_doi' from {_M} where len(list_filter(dc_identifier_doi, lambda x: {_trim('x')} <> '' and not regexp_full_match(x, '10\\.[0-9]{{4,9}}/[-._;()/:A-Za-z0-9]+'))) > 0")
    parts.append(f"select resource_id, 'brackets_in_title' from {_M} where len(list_filter(dc_title, lambda x: regexp_matches(x, '\\[.+\\]'))) > 0")
    parts.append(f"select resource_id, 'invalid_wos_id' from {_M} where len(list_filter(utb_identifier_wok, lambda x: {_trim('x')} <> '' and {_trim('x')} not like '0%')) > 0")
    inner = _norm("x")
    parts.append(
        f"select distinct i.resource_id, 'internal_not_in_authors' from (select resource_id, {inner} as n from (select resource_id, unnest(utb_contributor_internalauthor) as x from {_M}) t where x is not null) i "
        f"where not exists (select 1 from (select resource_id, {inner} as n from (select resource_id, unnest(dc_contributor_author) as x from {_M}) t2) a where a.resource_id = i.resource_id and a.n = i.n)"
    )
    return " union all ".join(parts)


_COMPARABLE = f"""
  select resource_id, {_title(_trim("dc_title[1]"))} as title,
    coalesce(array_to_string(list_sort(list_transform(dc_contributor_author, lambda x: {_norm("x")})), '|'), '') as authors,
    {_norm("dc_description_abstract[1]")} as abstract,
    coalesce(lower(regexp_replace(dc_identifier_issn[1], '[^0-9xX]', '', 'g')), '') as issn,
    coalesce(lower({_trim("dc_type[1]")}), '') as doctype,
    coalesce({_trim("utb_relation_volume")} <> '', false) or coalesce({_trim("utb_relation_issue")} <> '', false) as pages
  from {_M}"""

# The engine compares bytes: characters beyond ASCII are first replaced, the same in both texts, by single-byte ones.
_ALPHABET = "".join(chr(c) for c in range(48, 123) if chr(c) not in "'\\\\")


def similarity(a: str, b: str) -> str:
    """Jaro-Winkler similarity of two texts by characters."""
    chars = f"array_to_string(list_distinct(string_split({a} || {b}, '')), '')"
    return f"case when regexp_matches({a} || {b}, '[^\\x00-\\x7F]') then jaro_winkler_similarity(translate({a}, {chars}, '{_ALPHABET}'), translate({b}, {chars}, '{_ALPHABET}')) else jaro_winkler_similarity({a}, {b}) end"


_KEYS = """
  list_distinct(list_filter([
    'p16:' || substr(title, 1, 16), 'p24:' || substr(title, 1, 24),
    case when len(w) >= 2 then 'f2:' || array_to_string(w[1:2], ' ') end,
    case when len(w) >= 2 then 'l2:' || array_to_string(w[len(w)-1:len(w)], ' ') end,
    case when len(w) >= 3 then 'f3:' || array_to_string(w[1:3], ' ') end], lambda k: k is not null))"""

_CONTENT = f"""
with rows as (select * from ({_COMPARABLE}) t where title <> ''),
classes as (select title, authors, abstract, issn, doctype, pages, min(resource_id) as rep, count(*) as n from rows group by all),
keyed as (select *, unnest({_KEYS}) as k from (select *, string_split(title, ' ') as w from classes) t),
pairs as (
  select distinct a.rep as id_a, b.rep as id_b, a.title as ta, b.title as tb, a.issn as ia, b.issn as ib, a.doctype as da, b.doctype as db, a.pages as pa, b.pages as pb
  from keyed a join keyed b on a.k = b.k and a.rep < b.rep
  where (a.authors = '' or b.authors = '' or a.authors = b.authors) and (a.abstract = '' or b.abstract = '' or a.abstract = b.abstract)
    and ((a.authors <> '' and a.authors = b.authors) or (a.abstract <> '' and a.abstract = b.abstract) or (a.issn <> '' and a.issn = b.issn))),
scored as (select *, {similarity('ta', 'tb')} as score from pairs),
links as (
  select c.rep as id_a, r.resource_id as id_b, case when r.issn <> '' then 'exact:content' else 'autoplagiat' end as match_type, 1.0::double as score
  from rows r join classes c using (title, authors, abstract, issn, doctype, pages)
  where c.n > 1 and r.resource_id <> c.rep and (authors <> '' or abstract <> '' or issn <> '')
  union all
  select id_a, id_b,
    case when ia <> '' and ia = ib and pa <> pb then 'early_access'
         when not (ia <> '' and ia = ib) and list_sort([da, db]) = ['article', 'conferenceobject'] then 'merged_type'
         when not (ia <> '' and ia = ib) then 'autoplagiat' else 'exact:content' end,
    round(score, 4)
  from scored where score >= 0.96)
"""

_UNITS = "(select ref_id as id, canonical_name as name, parent_ref_id as parent_id from canonical_ref where kind in ('faculty', 'ou'))"

_CLOSURE = f"""
with recursive u as (select * from {_UNITS} t),
p as (select id as node, id as ancestor, 0 as depth from u union all select p.node, u.parent_id, p.depth + 1 from p join u on u.id = p.ancestor where u.parent_id is not null)
"""

_DOI_PREFIX = r"^(https?://(dx\.)?doi\.org/|doi:)"
_CLEAN_DOI = f"regexp_replace(regexp_replace({_trim(f"regexp_replace({_trim('x')}, '{_DOI_PREFIX}', '', 'i')")}, '(?s)[?#].*$', ''), '/+$', '')"

_GROUPS = f"""
groups as (
  select resource_id, case when issn is not null then 'issn' when isbn is not null then 'isbn' end as id_kind, coalesce(issn, isbn) as group_id, dc_publisher, dc_relation_ispartof, publisher, journal, tier
  from (select resource_id, ({_ISSNS})[1] as issn, ({_ISBNS})[1] as isbn, dc_publisher, dc_relation_ispartof,
    list_filter(list_transform(dc_publisher, lambda x: {_trim("x")}), lambda x: x <> '')[1] as publisher, list_filter(list_transform(dc_relation_ispartof, lambda x: {_trim("x")}), lambda x: x <> '')[1] as journal,
    case when len(utb_scopus_affiliation) > 0 then 0 when len(utb_wos_affiliation) > 0 then 1 else 2 end as tier from {_M}) t)"""


def _canon(value: str) -> str:
    return f"""(select id_kind, group_id, {value} from (select *, row_number() over (partition by id_kind, group_id order by tier, n desc, first) as k from
      (select id_kind, group_id, tier, {value}, count(*) as n, min(resource_id) as first from groups where group_id is not null and {value} is not null group by all) t) s where k = 1)"""


_PROPOSALS = f"""
with {_GROUPS},
canon as (select id_kind, group_id, publisher as p, journal as j from {_canon("publisher")} a full join {_canon("journal")} b using (id_kind, group_id)),
proposals as (
  select *, case when proposed_publisher is not null or proposed_journal is not null then 'has_proposal' else 'no_change' end as status from (
    select g.resource_id, g.group_id,
      case when p is not null and (dc_publisher is null or list_distinct(dc_publisher) is distinct from [p]) then p end as proposed_publisher,
      case when j is not null and (dc_relation_ispartof is null or list_distinct(dc_relation_ispartof) is distinct from [j]) then j end as proposed_journal
    from groups g left join canon c on g.id_kind = c.id_kind and g.group_id = c.group_id) t)
"""

_FLAGS = f"""
flags as (select resource_id,
  coalesce(len(list_filter(utb_source, lambda s: contains(lower(s), 'wos') or contains(lower(s), 'wok'))) > 0, false) as has_wos,
  coalesce(len(list_filter(utb_source, lambda s: contains(lower(s), 'scopus'))) > 0, false) as has_scopus,
  coalesce(len(list_filter(utb_source, lambda s: contains(lower(s), 'riv') or contains(lower(s), 'obd') or contains(lower(s), 'orig'))) > 0, false) as has_repository from {_M})"""

_IDS = f"list_concat(list_concat(list_transform(coalesce(dc_identifier_doi, []), lambda x: 'd' || lower({_trim('x')})), list_transform(coalesce(dc_identifier_issn, []), lambda x: 's' || lower({_trim('x')}))), list_transform(coalesce(dc_identifier_isbn, []), lambda x: 'b' || lower({_trim('x')})))"

_UTF8 = r"([\x{00}-\x{7F}]|[\x{C2}-\x{DF}][\x{80}-\x{BF}]|\x{E0}[\x{A0}-\x{BF}][\x{80}-\x{BF}]|[\x{E1}-\x{EC}\x{EE}\x{EF}][\x{80}-\x{BF}]{2}|\x{ED}[\x{80}-\x{9F}][\x{80}-\x{BF}]|\x{F0}[\x{90}-\x{BF}][\x{80}-\x{BF}]{2}|[\x{F1}-\x{F3}][\x{80}-\x{BF}]{3})*"
_WEST = "[" + ", ".join(map(str, (8364, 8218, 402, 8222, 8230, 8224, 8225, 710, 8240, 352, 8249, 338, 381, 8216, 8217, 8220, 8221, 8226, 8211, 8212, 732, 8482, 353, 8250, 339, 382, 376))) + "]"
_WEST_BYTES = "[" + ", ".join(map(str, (128, 130, 131, 132, 133, 134, 135, 136, 137, 138, 139, 140, 142, 145, 146, 147, 148, 149, 150, 151, 152, 153, 154, 155, 156, 158, 159))) + "]"
_CODES = f"list_transform(list_transform(string_split({{x}}, ''), lambda c: ord(c)), lambda c: coalesce({_WEST_BYTES}[list_position({_WEST}, c)], c))"
_AS_BYTES = "array_to_string(list_transform(" + _CODES + ", lambda c: chr(c::int)), '')"
_REREAD = f"case when {{x}} <> '' and regexp_matches({_AS_BYTES}, '[\\x{{80}}-\\x{{FF}}]') and regexp_full_match({_AS_BYTES}, '{_UTF8}') then try(decode(unhex(array_to_string(list_transform({_CODES}, lambda c: printf('%02x', c::int)), '')))) else {{x}} end"
_FIX = [
    ("mojibake", _REREAD.replace("{{", "{").replace("}}", "}")),
    ("encoding_chars", "replace(replace(replace(replace(replace(replace(replace(replace({x}, chr(57501), 'ft'), chr(57604), 'fl'), chr(57603), 'fi'), chr(256), chr(8220)), chr(284), 'ř'), chr(292), 'ů'), chr(3013), chr(8211)), chr(305), 'í')"),
    ("standalone_diacritics", "regexp_replace({x}, '" + _TESTS["standalone_diacritics"] + "', '', 'g')"),
    ("nbsp", "regexp_replace({x}, '" + _TESTS["nbsp"] + "', ' ', 'g')"),
    ("double_space", "regexp_replace({x}, ' {2,}', ' ', 'g')"),
]


def _text_fix() -> str:
    sql, at, before = f"select resource_id, pos, x as s0 from (select resource_id, unnest(dc_title) as x, generate_subscripts(dc_title, 1)::int as pos from {_M}) t where x is not null", 0, []
    for kind, expr in _FIX:
        sql = f"select *, {expr.replace('{x}', f's{at}')} as s{at + 1} from ({sql}) t{at}"
        before.append(f"s{at + 1} <> s{at} as {kind}")
        at += 1
    sql = f"select *, {_trim(f's{at}')} as s{at + 1} from ({sql}) t{at}"
    before.append(f"s{at + 1} <> s{at} as trailing_spaces")
    return f"select resource_id, pos, s{at + 1} as fixed, {', '.join(before)} from ({sql}) z where s{at + 1} <> s0"


_FORMS = f"""
forms as (
  select distinct author_id, {_match("name")} as norm from (
    select author_id, {_trim("x")} as name from (select author_id, unnest(list_concat(string_split(coalesce(display_name, ''), '||'), regexp_split_to_array(coalesce(other_name, ''), '\\|\\||;'))) as x from utb_authors) t
    union all select author_id, surname || ', ' || given_name from utb_authors where surname is not null and given_name is not null
    union all select author_id, given_name || ' ' || surname from utb_authors where surname is not null and given_name is not null) n where name <> '')"""

_PENDING = """
  select id, resource_id, field_key, target_table, new_value from (
    select *, row_number() over (partition by resource_id, field_key, target_table order by id desc, created_at desc, new_value desc) as k
    from utb_change_buffer where approved_at is null and discarded_at is null) t where k = 1"""

_SHOWN = {"dc.title": "dc_title", "dc.contributor.author": "dc_contributor_author", "dc.publisher": "dc_publisher", "dc.relation.ispartof": "dc_relation_ispartof", "dc.identifier.issn": "dc_identifier_issn", "utb.faculty": "utb_faculty", "utb.ou": "utb_ou"}


_BLOCK = r"(?s)\[([^\]]+)\]([^\[]*)"
_HOME = " or ".join(f"contains({_norm('affiliation')}, '{k}')" for k in Settings().home_keywords)
_WOS = f"""
with t as (select resource_id, text from (select resource_id, unnest(utb_wos_affiliation) as text from {_M}) x where text is not null and {_trim("text")} <> ''),
b as (select resource_id, unnest(regexp_extract_all(text, '{_BLOCK}', 1)) as names, unnest(regexp_extract_all(text, '{_BLOCK}', 2)) as place from t),
c as (select resource_id, list_filter(list_transform(string_split(names, ';'), lambda a: {_trim("a")}), lambda a: a <> '') as authors, regexp_replace(place, '^[;{_WS}]+|[;{_WS}]+$', '', 'g') as affiliation from b),
d as (select resource_id, unnest(case when len(authors) = 0 then [null] else authors end) as author, affiliation from c
  union all select resource_id, null, {_trim("text")} from t where len(regexp_extract_all(text, '{_BLOCK}', 1)) = 0)
select resource_id, author, affiliation, {_HOME} as is_home from d
"""


_LETTERS = "regexp_extract_all(strip_accents(lower({x})), '[a-z]+')"
_INITIALS = "array_to_string(list_transform({x}, lambda w: w[1]), '')"
_WORDS, _LEFT = _LETTERS.replace("{x}", "name"), _LETTERS.replace("{x}", "string_split(name, ',')[1]")
_RIGHT = _LETTERS.replace("{x}", "substr(name, instr(name, ',') + 1)")
_VARIANTS = f"""
with n as (select resource_id, name, pos, {_WORDS} as w, {_LEFT} as l, {_RIGHT} as r from (select resource_id, unnest(dc_contributor_author) as name, generate_subscripts(dc_contributor_author, 1) - 1 as pos from {_M}) t where {_trim("name")} <> ''),
k as (select *, case
    when contains(name, ',') and len(l) > 0 then array_to_string(l, ' ') || '|' || {_INITIALS.replace("{x}", "r")}
    when contains(name, ',') or len(w) = 0 then {_norm("name")}
    when len(w) > 1 and length(w[len(w)]) = 1 and length(w[1]) > 1 then w[1] || '|' || {_INITIALS.replace("{x}", "w[2:]")}
    else w[len(w)] || '|' || {_INITIALS.replace("{x}", "w[1:len(w)-1]")} end as key from n),
b as (select resource_id, key, min(pos) as first, arg_max(name, (contains(name, ',')::int, len(list_filter(w, lambda x: length(x) > 1)), length(regexp_replace(name, '[\\x00-\\x7F]', '', 'g')), length(name), -pos)) as name from k group by all)
select resource_id, array_to_string(list(name order by first), '||') as names from b group by 1
"""


def _workplace(x: str) -> str:
    centred = f"regexp_replace(replace({_norm(x)}, '&', ' and '), '\\bcenter\\b', 'centre', 'g')"
    return _match(centred)


_FIND = f"""
with t as (select distinct ou as text, {_workplace("ou")} as a from llm_author_entry where trim(ou) <> ''),
n as (select id, {_workplace("name")} as b from {_UNITS} u where parent_id is not null),
s as (select text, id, length(b) as l, case when a = b then 1 when contains(a, b) or contains(b, a) then greatest(0.92, jaro_winkler_similarity(a, b)) else jaro_winkler_similarity(a, b) end as score from t, n where a <> '' and b <> '')
select text, id, round(score, 4) as score from (select *, row_number() over (partition by text order by score desc, l desc, id) as k from s) z where k = 1 and score >= 0.92
"""

_W, _L = _LETTERS.replace("{x}", "name"), _LETTERS.replace("{x}", "string_split(name, ',')[1]")
_SIGNATURES = f"""list_distinct(list_filter(case when contains(name, ',') then [
    {{'s': array_to_string({_L}, ' '), 'i': {_INITIALS.replace("{x}", _RIGHT)}}}, {{'s': ({_L})[1], 'i': {_INITIALS.replace("{x}", _RIGHT)}}}, {{'s': ({_L})[-1], 'i': {_INITIALS.replace("{x}", _RIGHT)}}}]
  else [{{'s': ({_W})[-1], 'i': {_INITIALS.replace("{x}", f"({_W})[1:len({_W})-1]")}}}, {{'s': ({_W})[1], 'i': {_INITIALS.replace("{x}", f"({_W})[2:]")}}}] end, lambda g: coalesce(g.s, '') <> ''))"""
_MATCHES = f"""
with names as (select distinct name, {_match("name")} as norm from (select unnest(dc_contributor_author) as name from {_M}) t where {_trim("name")} <> ''),
written as (
  select distinct author_id, name, {_match("name")} as norm from (
    select author_id, {_trim("x")} as name from (select author_id, unnest(list_concat(string_split(coalesce(display_name, ''), '||'), regexp_split_to_array(coalesce(other_name, ''), '\\|\\||;'))) as x from utb_authors) t
    union all select author_id, surname || ', ' || given_name from utb_authors where surname is not null and given_name is not null
    union all select author_id, given_name || ' ' || surname from utb_authors where surname is not null and given_name is not null) n where name <> ''),
mine as (select name, norm, g.s as surname, g.i as initials from (select name, norm, unnest({_SIGNATURES}) as g from names) t),
theirs as (select distinct author_id, norm as their_norm, g.s as surname, g.i as their_initials from (select author_id, norm, unnest({_SIGNATURES}) as g from written) t),
near as (select m.*, t.author_id, t.their_norm, t.their_initials, m.initials <> '' and t.their_initials <> '' and (starts_with(t.their_initials, m.initials) or starts_with(m.initials, t.their_initials)) as fits from mine m join theirs t using (surname)),
found as (
  select name, 3 as stage, 'exact' as match_type from names join written using (name)
  union all select n.name, 4, 'exact_normalized' from names n join written w on n.norm = w.norm where n.norm <> ''
  union all select name, case when min(author_id) = max(author_id) then 5 else 6 end, case when min(author_id) = max(author_id) then 'initial_surname' else 'ambiguous_initials' end from near where fits group by name
  union all select name, 7, 'ambiguous_surname' from near where name in (select name from mine group by name having max(initials) = '') group by name having min(author_id) <> max(author_id)
  union all select name, 8, 'initial_mismatch' from near group by name having max(initials <> '') and not max(fits)
  union all select name, 9, 'fuzzy' from near where (initials = '' or fits) and jaro_winkler_similarity(norm, their_norm) >= 0.85)
select coalesce(match_type, 'none') as match_type, count(*) as n from names left join (select name, arg_min(match_type, stage) as match_type from found group by name) f using (name) group by 1
"""


def sql() -> dict[str, str]:
    """Query name to SQL."""
    doi, wok = (f"lower({_trim(f'{c}[1]')})" for c in ("dc_identifier_doi", "utb_identifier_wok"))
    shown = " union all ".join(f"select resource_id, '{k}' as field_key, array_to_string({c}, '||') as value from {_M}" for k, c in _SHOWN.items())
    a, b = (f"list_distinct(list_transform(coalesce({c}, []), lambda x: {_norm('x')}))" for c in ("dc_contributor_author", "utb_contributor_internalauthor"))
    joined = lambda c: f"array_to_string({c}, ' ')"
    search = " or ".join(f"coalesce({f} ilike '%polymer%', false)" for f in ("resource_id::varchar", *(joined(c) for c in ("dc_title", "dc_contributor_author", "dc_identifier_doi", "dc_relation_ispartof")), "dc_date_issued[1]", "concat_ws('/', utb_relation_volume, utb_relation_issue)"))
    return {
        "dedup_exact_groups": f"select {doi} as value, min(resource_id) as kept_id, count(*) as n from {_M} where {doi} <> '' group by 1 having count(*) > 1",
        "dedup_exact_members": f"with v as (select resource_id, {doi} as value from {_M}), g as (select value, min(resource_id) as kept_id from v where value <> '' group by 1 having count(*) > 1) select value, kept_id, resource_id from v join g using (value) where resource_id <> kept_id",
        "dedup_pair_count": f"select coalesce(sum(n * (n - 1) / 2), 0)::bigint as pairs from (select count(*) as n from {_M} where {wok} <> '' group by {wok} having count(*) > 1) t",
        "dedup_content_links": _CONTENT + "select * from links",
        "dedup_link_counts": _CONTENT + "select match_type, count(*) as n from links group by 1",
        "dedup_survivors": _CONTENT + f""", f as (select resource_id, pages, doctype = 'article' as article from ({_COMPARABLE}) t),
            x as (select l.*, case when match_type = 'early_access' and b.pages and not a.pages then id_b when match_type = 'merged_type' and b.article and not a.article then id_b else id_a end as special
              from links l join f a on a.resource_id = id_a join f b on b.resource_id = id_b),
            k as (select id_a, id_b, match_type, score, case when match_type in ('early_access', 'merged_type') then special else least(id_a, id_b) end as kept_id from x)
            select *, case when kept_id = least(id_a, id_b) then greatest(id_a, id_b) else least(id_a, id_b) end as deleted_id from k""",
        "dedup_history_status": "select dedup_match_type, count(*) as n, count(distinct dedup_kept_resource_id) as kept from dedup_histoire group by 1",
        "dedup_history_details": "select json_extract_string(dedup_match_details, '$.by') as basis, count(*) as n from dedup_histoire group by 1",
        "merged_children": "select kept_id, resource_id, row_number() over (partition by kept_id order by merged_at desc, resource_id)::int as n from (select dedup_kept_resource_id::bigint as kept_id, resource_id, max(dedup_merged_at) as merged_at from dedup_histoire where resource_id <> dedup_kept_resource_id group by all) t",
        "text_fix": _text_fix(),
        "doi_clean": f"select resource_id, pos, {_trim('x')} = '' or regexp_full_match(x, '10\\.[0-9]{{4,9}}/[-._;()/:A-Za-z0-9]+') as valid, {_CLEAN_DOI} as cleaned, regexp_full_match({_CLEAN_DOI}, '10\\.[0-9]{{4,9}}/[-._;()/:A-Za-z0-9]+') as valid_after from (select resource_id, unnest(dc_identifier_doi) as x, generate_subscripts(dc_identifier_doi, 1)::int as pos from {_M}) t where x is not null",
        "issn_parse": f"select resource_id, array_to_string({_ordered_distinct('v')}, '|') as issns from (select resource_id, {_ISSNS} as v from {_M}) t where len(v) > 0",
        "isbn_parse": f"select resource_id, array_to_string({_ordered_distinct('v')}, '|') as isbns from (select resource_id, {_ISBNS} as v from {_M}) t where len(v) > 0",
        "year_histogram": f"select try_cast(nullif(regexp_extract(dc_date_issued[1], '\\b((?:19|20)\\d{{2}})\\b', 1), '') as int) as year, count(*) as n from {_M} group by 1",
        "title_keys": f"select block_key, count(*) as n from (select unnest({_KEYS}) as block_key from (select title, string_split(title, ' ') as w from (select {_title('dc_title[1]')} as title from {_M}) a where title <> '') b) c group by 1 having count(*) > 1",
        "validation_rules": _rules(),
        "validation_issue_counts": f"select rule, count(*) as n from ({_rules()}) t group by 1",
        "validation_status": f"with bad as (select distinct resource_id from ({_rules()}) t) select case when b.resource_id is null then 'ok' else 'has_issues' end as status, count(*) as n from {_M} m left join bad b using (resource_id) group by 1",
        "obd_missing": f"select resource_id, array_to_string(list_sort(list(distinct x)), '|') as missing from (select resource_id, unnest(utb_identifier_obdid) as x from {_M}) t where trim(x) <> '' and x not in (select (resource_id + 43000000)::varchar from documents where resource_id is not null) group by 1",
        "wos_blocks": _WOS,
        "dedup_flags": _CONTENT + f""", two as (select id_a as resource_id, id_b as other, match_type, score from links union select id_b, id_a, match_type, score from links)
            select t.*, exists (select 1 from {_M} m where m.resource_id = t.other) as is_live from two t""",
        "dedup_flag_counts": _CONTENT + "select match_type, count(*) as n from (select id_a, id_b, match_type, score from links union select id_b, id_a, match_type, score from links) t group by 1",
        "pending_records": f"select resource_id, count(*) as n_changes from ({_PENDING}) t group by 1",
        "author_status": f"select case when utb_contributor_internalauthor is null then 'not_processed' else 'processed' end as status, count(*) as n from {_M} group by 1",
        "name_prefixes": "select distinct author_id, poradie, display_name, surname, round(case when greatest(length(display_name), length(surname)) = 0 then 0 else len(list_filter(range(1, least(length(display_name), length(surname)) + 1), lambda k: display_name[1:k] = surname[1:k])) / greatest(length(display_name), length(surname)) end, 6) as ratio from utb_authors where display_name is not null and surname is not null",
        "author_summaries": f"select name, count(distinct author_id) as persons, count(*) as places, coalesce(array_to_string(list_sort(list(distinct faculty) filter (faculty is not null)), '||'), '') as faculties from (select {_norm('display_name')} as name, author_id, nullif(trim(faculty), '') as faculty from utb_authors) t where name <> '' group by 1",
        "find_units": _FIND,
        "author_match_status": _MATCHES,
        "match_exact": f"with {_FORMS}, names as (select distinct name, {_match('name')} as norm from (select unnest(dc_contributor_author) as name from {_M}) t where trim(name) <> '') select name, min(author_id) as author_id, count(distinct author_id) as n from names join forms using (norm) where norm <> '' group by 1",
        "default_affiliations": f"""with u as (select * from {_UNITS} t), r as (select a.author_id, coalesce(nullif(trim(a.faculty), ''), p.name) as faculty, case when u.parent_id is not null then u.name end as ou from utb_authors a left join u on u.id = a.organization_id left join u p on p.id = u.parent_id)
            select author_id, min(faculty) as faculty, arg_max(ou, (length(ou), ou)) as ou from r group by 1""",
        "compare_curated": f"""with k as (select case when len(a) = 0 and len(b) = 0 then 'both_empty' when len(a) = 0 then 'only_right' when len(b) = 0 then 'only_left' when len(list_filter(a, lambda x: not list_contains(b, x))) = 0 and len(list_filter(b, lambda x: not list_contains(a, x))) = 0 then 'equal' when list_has_any(a, b) then 'partial' else 'different' end as agreement from (select {a} as a, {b} as b from {_M}) t)
            select agreement, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 2)::double as percent from k group by 1""",
        "name_similarity": f"select distinct author_id, poradie, display_name, concat_ws(', ', surname, given_name) as \"full\", round(case when x = '' or y = '' then 0 else jaro_winkler_similarity(x, y) end, 4) as score from (select *, {_norm('display_name')} as x, {_norm("concat_ws(', ', surname, given_name)")} as y from utb_authors where concat_ws(', ', surname, given_name) <> '' and display_name is not null) t",
        "tree_closure": _CLOSURE + "select node, ancestor, depth from p",
        "walk_to_faculty": _CLOSURE + "select node, arg_min(ancestor, (depth, ancestor)) as ancestor from p join u on u.id = p.ancestor where u.parent_id is null group by 1",
        "journal_canonical": f"with {_GROUPS} select * from {_canon('journal')} t",
        "journal_proposals": _PROPOSALS + "select * from proposals",
        "journal_status": _PROPOSALS + "select status, count(*) as n from proposals group by 1",
        "journal_top_groups": _PROPOSALS + "select group_id, count(*) as n from proposals where status = 'has_proposal' group by 1 order by n desc, group_id limit 10",
        "journal_group_report": f"with {_GROUPS} select group_id, journal as value, count(*) as n from groups where group_id is not null and journal is not null group by all",
        "source_flags": f"with {_FLAGS} select * from flags",
        "list_groups": f"""with {_FLAGS}, ids as (select resource_id, utb_source, unnest({_IDS}) as x from {_M}),
            known as (select distinct x from ids where length(x) > 1 and len(list_filter(utb_source, lambda s: lower(s) like '%-riv' or lower(s) like '%-obd' or lower(s) like '%-orig')) > 0)
            select f.resource_id, case when exists (select 1 from ids i join known k on i.x = k.x where i.resource_id = f.resource_id) then 'existing' when has_wos and has_scopus then 'duplicate' else 'single' end as list_group
            from flags f join {_M} m using (resource_id) where not coalesce(m.withdrawn, false) and not (has_repository and not has_wos and not has_scopus)""",
        "merge_variants": _VARIANTS,
        "source_lists": f"""with t as (select resource_id, coalesce(len(list_filter(utb_source, lambda x: regexp_matches(lower(x), 'wos|wok'))) > 0, false) as w, coalesce(len(list_filter(utb_source, lambda x: contains(lower(x), 'scopus'))) > 0, false) as s, unnest(dc_contributor_author) as name from {_M}),
            h as (select dedup_kept_resource_id::bigint as resource_id, coalesce(len(list_filter(utb_source, lambda x: regexp_matches(lower(x), 'wos|wok'))) > 0, false) as w, coalesce(len(list_filter(utb_source, lambda x: contains(lower(x), 'scopus'))) > 0, false) as s, unnest(dc_contributor_author) as name
              from (select dedup_kept_resource_id, any_value(utb_source) as utb_source, any_value(dc_contributor_author) as dc_contributor_author from dedup_histoire where resource_id <> dedup_kept_resource_id group by resource_id, dedup_kept_resource_id) k),
            u as (select * from h union all select * from t where w <> s and resource_id not in (select resource_id from h)),
            l as (select 'wos' as source, resource_id from u where w union all select 'scopus', resource_id from u where s union all select 'repo', resource_id from u where w union all select 'repo', resource_id from u where s union all select 'repo', resource_id from t)
            select source, count(*) as n, count(distinct resource_id) as records from l group by 1""",
        "wos_block_warnings": f"""with t as (select resource_id, text from (select resource_id, unnest(utb_wos_affiliation) as text from {_M}) x),
            b as (select resource_id, coalesce({_trim("text")}, '') <> '' as ok, case when coalesce({_trim("text")}, '') = '' then [] when len(regexp_extract_all(text, '{_BLOCK}', 1)) = 0 then [{_trim("text")}] else list_transform(regexp_extract_all(text, '{_BLOCK}', 2), lambda p: regexp_replace(p, '^[;{_WS}]+|[;{_WS}]+$', '', 'g')) end as places from t)
            select resource_id, sum(len(places))::bigint as n_blocks, sum(len(list_filter(places, lambda affiliation: {_HOME})))::bigint as n_home, min(ok::int)::boolean as ok from b group by 1""",
        "list_group_counts": f"""with {_FLAGS}, ids as (select resource_id, utb_source, unnest({_IDS}) as x from {_M}),
            known as (select distinct x from ids where length(x) > 1 and len(list_filter(utb_source, lambda s: lower(s) like '%-riv' or lower(s) like '%-obd' or lower(s) like '%-orig')) > 0)
            select case when exists (select 1 from ids i join known k on i.x = k.x where i.resource_id = f.resource_id) then 'existing' when has_wos and has_scopus then 'duplicate' else 'single' end as list_group, count(*) as n
            from flags f join {_M} m using (resource_id) where not coalesce(m.withdrawn, false) and not (has_repository and not has_wos and not has_scopus) group by 1""",
        "search_records": f"select resource_id, dc_title[1] as title, dc_date_issued[1] as issued from {_M} where ({search}) and not coalesce(withdrawn, false)",
        "search_authors": f"select distinct author_id, display_name from utb_authors where contains({_norm("concat_ws(' ', display_name, other_name, faculty)")}, 'olga') order by 1, 2 limit 50",
        "pending_changes": _PENDING,
        "pending_overlay": f"select s.resource_id, s.field_key, case when p.id is not null and p.new_value is not null then p.new_value else s.value end as shown, p.id is not null as is_pending from ({shown}) s left join (select * from ({_PENDING}) q where target_table = '{_M}') p using (resource_id, field_key)",
        "crossref_fields": f"""select resource_id, {_joined_values('dc_title')} as dc_title, {_trim('dc_publisher[1]')} as dc_publisher, utb_relation_volume, {_joined_values('dc_identifier_issn')} as dc_identifier_issn, {_joined_values('dc_contributor_author')} as dc_contributor_author,
            string_split(concat_ws('-', dc_citation_spage[1], dc_citation_epage[1]), '-')[1] as dc_citation_spage from {_M}""",
        "queue_missing": f"select distinct resource_id, 'not_checked' as validation_status from {_M} where resource_id not in (select resource_id from documents where resource_id is not null)",
        "json_props": "select event_type, count(*) as n, sum(try_cast(json_extract_string(props, '$.k') as bigint))::bigint as total from events group by 1",
    }


def _joined_values(column: str) -> str:
    return f"nullif(array_to_string(list_filter(list_transform({column}, lambda x: {_trim('x')}), lambda x: x <> ''), '||'), '')"
