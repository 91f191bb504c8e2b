"""Variant spellings of names typed by people: every canonical rewriting of both sides, an equi-join, rarity as score.

Plan: names are made distinct, so that a name counts once however often it is typed. An Arrow pass on each side writes
every canonical rewriting of a name (order of parts, titles, accents and transliterations, nicknames, abbreviations,
initials, legal forms of organisations, one dropped letter) as a 64-bit form; names and registry meet in an equi-join on
forms. Forms that several persons share say nothing about which is meant and leave before the join, so no group of the
join can grow with the registry; the rest are scored by rarity less what the rewriting costs, and typing errors are
checked exactly. Forms with a dropped letter, the many ones, are only written for the names that the other forms leave
open: where a cheaper rewriting meets a person, a typing error can neither win nor come near.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from scriptorium.llm import mojibake
from scriptorium.plans.lineage import reliable

# Academic titles.
TITLES = frozenset("ing mgr phdr rndr mudr judr mvdr paeddr thdr bc mga dr doc prof phd csc drsc dis mba msc thd artd dipl univ hc jr sr".split())
# Legal forms of organisations, without blanks and full stops; those of the second line only where written with full stops.
LEGAL_FORMS = frozenset("sro spolsro gmbh mbh ltd limited inc incorporated llc corp corporation plc kgaa vvi ops zs oyj srl sarl spzoo doo".split())
DOTTED_LEGAL_FORMS = frozenset("as sa ag bv nv kg ks co se oy ab zu pbc spa".split())
# Nicknames and the names that they stand for.
NICKNAMES = """
Jirka:Jiří Jura:Jiří Jíra:Jiří Honza:Jan Jenda:Jan Pepa:Josef Jožka:Josef Joska:Josef Franta:František Fanda:František Tonda:Antonín Toník:Antonín
Láďa:Vladimír,Ladislav Vláďa:Vladimír Laco:Ladislav Standa:Stanislav Stáňa:Stanislav Jarda:Jaroslav Jára:Jaroslav Mirek:Miroslav Míra:Miroslav
Zdenda:Zdeněk Zdeňa:Zdeněk Vašek:Václav Venca:Václav Ota:Otakar Oťas:Otakar Luboš:Ľubomír Lubo:Ľubomír Ľubo:Ľubomír Ondra:Ondřej Tom:Tomáš Tomík:Tomáš
Míša:Michal,Michaela Michálek:Michal Kuba:Jakub Péťa:Petr,Petra Peťa:Petr,Petra Bára:Barbora Barča:Barbora Verča:Veronika Verka:Veronika Nika:Veronika,Nikola
Zuzka:Zuzana Zuzi:Zuzana Hanka:Hana Hanička:Hana Lenča:Lenka Lída:Ludmila Liduška:Ludmila Katka:Kateřina Káča:Kateřina Kačka:Kateřina Kateřinka:Kateřina
Terka:Tereza Terezka:Tereza Jarka:Jarmila,Jaroslava Jarča:Jarmila Gábina:Gabriela Gabika:Gabriela Gabka:Gabriela Gába:Gabriela Magda:Magdaléna Maky:Markéta
Markétka:Markéta Majka:Marie Olina:Olga Olinka:Olga Ivča:Ivana Iva:Ivana Ivanka:Ivana Simča:Simona Simonka:Simona Renča:Renata Rena:Renata Raďa:Radka,Radim
Radek:Radim Dáša:Dagmar Daša:Dagmar Dáda:Dagmar Božka:Božena Boženka:Božena Blaňa:Blanka Běta:Alžběta Bětka:Alžběta Bětuška:Alžběta Áďa:Adéla Adélka:Adéla
Niki:Nikola Nikča:Nikola Žanetka:Žaneta Žaňa:Žaneta Věrka:Věra Verunka:Věra,Veronika Bohouš:Bohumil Bohuš:Bohumil Boža:Bohumil,Božena Eda:Eduard Edo:Eduard Edík:Eduard Kája:Karel,Karolína
Karlík:Karel Vojta:Vojtěch Vojtík:Vojtěch Viky:Viktor Viki:Viktor Pavlík:Pavel Pája:Pavel,Pavla Luky:Lukáš Lukášek:Lukáš Dan:Daniel Danek:Daniel Dany:Daniel Saša:Alexander
Alex:Alexander Bert:Norbert Norb:Norbert Ríša:Richard Rišo:Richard Šári:Šárka Šárinka:Šárka Uršulka:Uršula Uša:Uršula Ula:Uršula Fany:Františka Fanynka:Františka Fráňa:Františka
Gusta:Gustav Gustík:Gustav Romča:Roman Áda:Adam,Adéla Dušek:Dušan Dušanek:Dušan Libek:Libor Kryša:Kryštof Kryštůfek:Kryštof Eliška:Eliška Eli:Eliška Elinka:Eliška Emilek:Emil Mila:Emil,Ludmila,Miloslava
Hynda:Hynek Cyrda:Cyril Petruška:Petra Šimi:Šimon Šimonek:Šimon Igorek:Igor
"""

#: What a rewriting costs, in the nats of the rarity score.
COST = {"fold": 0.0, "nick": 1.0, "cut": 2.0, "typo": 3.0, "initial": 4.0}
HOWS = tuple(COST)
_TYPO = HOWS.index("typo")
MARGIN = 0.4
#: Bits of the bitmap of known forms: sixteen for each form, two of which it sets; from 8 kB to at most 16 MB whatever the registry.
LEAST_BITS, MOST_BITS = 16, 27


#: Marks and hidden characters are dropped; letters that have no decomposition are spelt simply.
_SPELT = {cp: None for cp in range(0x80, 0x1FFFF) if unicodedata.combining(chr(cp)) or unicodedata.category(chr(cp)) == "Cf"}
_SPELT |= str.maketrans({"ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "ı": "i"})


def plain(text: str) -> str:
    """Lower case, accents and hidden characters dropped."""
    text = text.lower()
    return text if text.isascii() else unicodedata.normalize("NFKD", text).lower().translate(_SPELT)


def fold(text: str) -> str:
    """Transliterations of one sound written alike; applied to both sides, so it may merge more than sounds."""
    for a, b in (("rz", "r"), ("zh", "z"), ("sh", "s"), ("sch", "s"), ("ch", "c"), ("cz", "c"), ("ue", "u"), ("oe", "o"), ("ae", "a"), ("ie", "e"), ("je", "e"), ("w", "v"), ("y", "i"), ("j", "i")):
        text = text.replace(a, b)
    return text


@lru_cache(maxsize=1)
def nicknames() -> dict[str, tuple[str, ...]]:
    """Plain nickname to the plain names it may stand for."""
    out: dict[str, tuple[str, ...]] = {}
    for pair in NICKNAMES.split():
        nick, names = pair.split(":")
        out[plain(nick)] = tuple(plain(n) for n in names.split(",") if plain(n) != plain(nick))
    return out


class Reading(NamedTuple):
    """One way to read a name: surname and given name in plain letters; ``cut`` marks an abbreviated given name."""

    surname: str
    given: str
    cut: bool


def readings(name: str) -> list[Reading]:
    """All readings of a typed name: titles dropped, parts in either order unless a comma or an initial settles it."""
    text = re.sub(r"\bph\.\s*d\b\.?|\bdr\.\s*h\.\s*c\.?", " ", plain(name).replace(";", ","))
    halves = [[w for w in re.findall(r"[^\W\d_?�](?:[^\W\d_]|[?�'’-])*[.]?|[?�](?:[^\W\d_]|[?�'’-])+[.]?", part) if w.rstrip(".") not in TITLES] for part in text.split(",")]
    halves = [h for h in halves if h]
    if not halves:
        return []
    is_cut = lambda w: w.endswith(".") or len(w) == 1
    out: list[Reading] = []

    def add(surname: list[str], given: list[str]) -> None:
        if surname and given:
            word = next((w for w in given if not is_cut(w)), given[0]) if is_cut(given[0]) and len(given) > 1 else given[0]
            r = Reading(" ".join(w.rstrip(".") for w in surname), word.rstrip("."), is_cut(word))
            if len(r.surname) > 1 and r.given and r not in out:
                out.append(r)

    if len(halves) > 1:
        add(halves[0], halves[1])
        return out
    parts = halves[0]
    if len(parts) == 1:
        return []
    if len(parts) == 2 and parts[0].endswith(".") and len(parts[0]) > 3:  # a full stop typed for a comma
        add(parts[:1], parts[1:])
    if not is_cut(parts[0]):
        add(parts[:1], parts[1:])
        if len(parts) > 2 and not any(map(is_cut, parts)):
            add(parts[:-1], parts[-1:])
    if not is_cut(parts[-1]):
        add(parts[-1:], parts[:-1])
    return out


_SPACED_FORM = re.compile(r"\b(?:spol\.?\s*s\s*r\.?\s*o|sp\.?\s*z\s*o\.?\s*o)\b\.?")


_ENDS = LEGAL_FORMS | DOTTED_LEGAL_FORMS | {"o"}  # the last word of every legal form


def organisation(name: str) -> str | None:
    """Words of an organisation's name in one order, its legal form left out; None for a name without a legal form at its end."""
    if name.rstrip(" .,").rpartition(" ")[2].replace(".", "").lower() not in _ENDS:
        return None
    text = _SPACED_FORM.sub(" spolsro", plain(name)).replace("&", " and ")
    words = re.findall(r"[^\W_](?:[^\W_]|[.'’-])*", text)
    kept = list(words)
    while kept and ((bare := kept[-1].replace(".", "")) in LEGAL_FORMS or bare in DOTTED_LEGAL_FORMS and "." in kept[-1]):
        kept.pop()
    if not kept or len(kept) == len(words):
        return None
    kept = [w.replace(".", "") for w in kept]
    return " ".join(sorted(fold(w) for w in kept if w not in ("and", "a", "the", "of")) or kept)


def _drops(text: str) -> set[str]:
    return {text[:i] + text[i + 1 :] for i in range(len(text)) if not i or text[i] != text[i - 1]}


_digest, _HALF = xxhash.xxh64_intdigest, 1 << 63


def form(kind: str, text: str) -> int:
    """64-bit number of a form."""
    return _digest(f"{kind}:{text}") - _HALF


def typo_key(r: Reading) -> str:
    """What typing errors are counted on."""
    return r.surname + " " + r.given


def forms(name: str, of_person: bool, known: bytes | None = None, dropped: bool | None = None) -> list[tuple[int, int, str]]:
    """(form, number of the rewriting in ``HOWS``, text that is compared) of a name, cheapest rewriting first.

    A person's name is also written with every abbreviation of the given name, a typed name with every name that its
    given name may be short for; both with one letter dropped. Forms outside the bitmap ``known`` are left out, if one is
    given; ``dropped`` asks for only the forms with a dropped letter, or only the others.
    """
    out: dict[int, tuple[int, str]] = {}
    mask = (len(known) << 3) - 1 if known is not None else 0

    def put(kind: str, text: str, how: str, check: str = "") -> None:
        f = form(kind, text)
        if known is None or known[(f & mask) >> 3] >> (f & 7) & 1 and known[(f >> 32 & mask) >> 3] >> (f >> 32 & 7) & 1:
            out.setdefault(f, (HOWS.index(how), check))

    if dropped is not True and (house := organisation(name)):
        put("house", house, "fold", house)
    for r in readings(name):
        bare = r.surname.replace("?", "").replace("�", ""), r.given.replace("?", "").replace("�", "")
        lost = bare != (r.surname, r.given)
        if not lost and (len(r.given) == 1 or r.cut):
            if dropped is not True:
                how = "initial" if len(r.given) == 1 else "cut"
                put(how, f"{fold(r.surname)} {r.given}", how)
            continue
        if not lost and dropped is not True:
            s = fold(r.surname)
            put("fold", fold(typo_key(r)), "fold", typo_key(r))
            for g in (r.given, *nicknames().get(r.given, ())):
                if g != r.given:
                    put("fold", fold(f"{r.surname} {g}"), "nick")
            if of_person:
                put("initial", f"{s} {r.given[0]}", "initial")
                for k in range(2, len(r.given)):
                    put("cut", f"{s} {r.given[:k]}", "cut")
        if dropped is not False and len(bare[1]) > 1:
            key = typo_key(Reading(*bare, False))
            for d in (key,) if lost else (key, *_drops(key)):  # the many: written out for speed
                f = _digest(f"drop:{d}") - _HALF
                if known is None or known[(f & mask) >> 3] >> (f & 7) & 1 and known[(f >> 32 & mask) >> 3] >> (f >> 32 & 7) & 1:
                    out.setdefault(f, (_TYPO, key))
    return [(f, how, check) for f, (how, check) in out.items()]


def split_names(text: str | None) -> list[str]:
    """Names packed into one registry field: divided by ``||``, else by semicolons."""
    if not text:
        return []
    return [n.strip() for n in (text.split("||") if "||" in text else text.split(";")) if n.strip()]


_FORMS = "form bigint, how tinyint, check string"


@lru_cache(maxsize=1)
def _damage() -> re.Pattern:
    """Matches names that may be damaged: a misread multi-byte letter, or a Western letter or sign in the place of a Central European one."""
    changed = {ch for true in ("cp1250", "iso8859_2") for ch in map(chr, mojibake._rereading("cp1252", true)[1])}
    return re.compile(mojibake._any_sequence().pattern + "|[" + re.escape("".join(sorted(changed))) + "]")


def _write_forms(names: DataFrame, of_person: bool, counts=None, known: bytes | None = None, dropped: bool | None = None) -> DataFrame:
    """``names`` (id, name) with every form of each name (see :func:`forms`), damaged names repaired first if ``counts`` are given."""
    head = names.columns[0]
    kind = dict(names.dtypes)[head]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plausible = mojibake.Plausibility(counts) if counts is not None else None
        for b in batches:
            ids: list = []
            rows: list = []
            for rid, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                damaged = plausible is not None and not name.isascii() and _damage().search(name)
                found = forms(plausible.repair(name) if damaged else name, of_person, known, dropped)
                rows += found
                ids += [rid] * len(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, b.column(0).type), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int8()), pa.array([r[2] for r in rows], pa.string())],
                names=[head, "form", "how", "check"],
            )

    return names.mapInArrow(write, f"{head} {kind}, {_FORMS}")


def _bitmap(written: DataFrame) -> bytes:
    """Which forms occur, one bit for each class of forms; the size follows the number of forms up to ``MOST_BITS``.

    Typed forms outside it meet no person and needn't be shuffled. A full bitmap only filters less.
    """
    bits_wanted = min(MOST_BITS, max(LEAST_BITS, (16 * written.count()).bit_length()))
    size, piece = 1 << (bits_wanted - 3), 1 << 13
    mask = (1 << bits_wanted) - 1

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, dtype=np.uint8)
        for b in batches:
            forms_ = b.column(0).to_numpy()
            for at in (forms_ & mask, (forms_ >> 32) & mask):
                np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        some = [k for k in range(size // piece) if bits[k * piece : (k + 1) * piece].any()]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([bits[k * piece : (k + 1) * piece].tobytes() for k in some], pa.binary())], names=["piece", "bits"])

    def merge(group: pa.Table) -> pa.Table:
        bits = np.zeros(piece, dtype=np.uint8)
        for b in group.column("bits").to_pylist():
            bits |= np.frombuffer(b, dtype=np.uint8)
        return pa.table({"piece": group.column("piece")[:1], "bits": pa.array([bits.tobytes()], pa.binary())})

    out = bytearray(size)
    for r in written.select("form").mapInArrow(mark, "piece int, bits binary").groupBy("piece").applyInArrow(merge, "piece int, bits binary").collect():
        out[r["piece"] * piece : (r["piece"] + 1) * piece] = r["bits"]
    return bytes(out)


def registry_names(registry: DataFrame) -> DataFrame:
    """``author_id, name, is_display`` of every way a registry names a person, once each."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for rid, shown, other, surname, given, middle in zip(*(b.column(i).to_pylist() for i in range(6))):
                if rid is None:
                    continue
                out += [(rid, n, True) for n in (shown or "").split("||") if n.strip()]
                out += [(rid, n, False) for n in split_names(other)]
                if surname and given:
                    out += [(rid, f"{surname}, {given}", False)]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.bool_())], names=["author_id", "name", "is_display"])

    rows = registry.select(F.col("author_id").cast("bigint"), "display_name", "other_name", "surname", "given_name", "middle_name").distinct()
    return rows.mapInArrow(split, "author_id bigint, name string, is_display boolean").distinct()


def link_names(names: DataFrame, registry: DataFrame, counts=None) -> DataFrame:
    """``name, author_id, score`` of every distinct typed ``name`` that means exactly one person of ``registry``.

    ``registry`` has ``author_id, display_name, other_name, surname, given_name, middle_name``. The score is the rarity of
    the best shared form (log of persons over persons with the form) less the costs of both rewritings. A name of which
    two persons are within ``MARGIN`` means none. ``counts``: character statistics to repair damaged names by.
    Null, empty and one-word names mean none; repeated rows count once; an empty side gives an empty result; names of
    any length are read whole. Other columns are ignored.
    """
    spread = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # few bytes but much work: spread by number, or adaptive execution would put them all into one task
    known = registry_names(registry).select("author_id", "name").distinct().repartition(spread)
    persons = max(2, registry.agg(F.approx_count_distinct("author_id", 0.01)).first()[0])
    theirs = _write_forms(known, of_person=True)
    theirs = theirs.groupBy("form", "author_id", "check").agg(F.min(F.struct(_cost("how").alias("cost"), "how")).alias("r"))
    # Rarity: a form of several persons tells nothing, but for typing errors, where the exact check tells persons apart.
    per_form = theirs.groupBy("form").agg(F.min("author_id").alias("a"), F.max("author_id").alias("b"), F.approx_count_distinct("author_id").alias("about"))
    per_form = per_form.select("form", F.when(F.col("a") == F.col("b"), 1).otherwise(F.greatest("about", F.lit(2))).alias("df"))
    theirs = theirs.join(per_form.hint("merge"), "form").filter((F.col("df") == 1) | (F.col("r.how") == _TYPO)).select("form", "df", "author_id", F.col("r.cost").alias("cost"), F.col("check").alias("their_check"))
    theirs = reliable(theirs)  # read for the bitmap and both joins
    bitmap = _bitmap(theirs)
    typed = reliable(names.select("name").filter(F.trim("name") != "").distinct())
    plainly = reliable(_scored(_write_forms(typed.select("name", F.col("name").alias("n")), False, counts, bitmap, dropped=False), theirs, persons))
    # what a typing error can score at most, and still be told apart from
    settled = plainly.groupBy("name").agg(F.max("score").alias("best")).filter(F.col("best") >= math.log(persons) - COST["typo"] + MARGIN)
    left = typed.join(settled.select("name").hint("merge"), "name", "left_anti").repartition(spread)
    mistyped = _scored(_write_forms(left.select("name", F.col("name").alias("n")), False, counts, bitmap, dropped=True), theirs, persons)
    best = plainly.unionByName(mistyped).groupBy("name", "author_id").agg(F.max("score").alias("score"))
    top = best.groupBy("name").agg(F.max(F.struct("score", "author_id")).alias("top"), F.sort_array(F.collect_list("score"), False).alias("scores"))
    clear = (F.size("scores") == 1) | (F.element_at("scores", 1) - F.try_element_at("scores", F.lit(2)) >= MARGIN)
    return top.filter(clear).select("name", "top.author_id", "top.score")


def _scored(ours: DataFrame, theirs: DataFrame, persons: int) -> DataFrame:
    """``name, author_id, score`` of names and persons that share a form, typing errors checked exactly."""
    met = ours.join(theirs.hint("merge"), "form")
    # a dropped letter on either side is a typing error only within one edit, checked on the whole
    typo, far = F.col("how") == _TYPO, F.levenshtein("check", "their_check", 2)
    right = F.when(~typo, True).when(far.isin(0, 1), True).when((far == 2) & (F.length("check") == F.length("their_check")), _is_swap(F.col("check"), F.col("their_check"))).otherwise(False)
    less = F.when(F.col("check") == F.col("their_check"), 0.0).when(typo, 0.2).when(F.col("how") == HOWS.index("fold"), 0.5).otherwise(0.0)
    cost = _cost("how") + F.when(typo, 0.0).otherwise(F.col("cost")) + less
    score = F.log(F.lit(persons) / F.col("df")) - cost
    return met.filter(right).groupBy("name", "author_id").agg(F.max(score).alias("score"))


def _cost(how: str) -> Column:
    out = F.lit(0.0)
    for k, c in enumerate(COST.values()):
        out = F.when(F.col(how) == k, c).otherwise(out)
    return out


def _is_swap(a: Column, b: Column) -> Column:
    """Whether b is a with two neighbours swapped."""
    at = F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1)))
    swapped = lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a)))
    return F.exists(at, lambda i: swapped(i) == b)


def p1_found(records: DataFrame, registry: DataFrame) -> DataFrame:
    """Author elements that mean a registered person but aren't written as a display name of theirs."""
    names = records.select("resource_id", F.posexplode("dc_contributor_author").alias("p", "name")).filter(F.trim("name") != "")
    rows = registry.select(F.col("author_id").alias("resource_id"), F.array_compact(F.array("display_name", "other_name")).alias("names"))
    counts = mojibake.corpus_counts(rows, ("names",))
    linked = link_names(names, registry, counts)
    shown = registry_names(registry).filter("is_display").select("author_id", "name")
    shown = shown.unionByName(shown.withColumn("name", F.trim("name"))).distinct()
    # both sides grow with the tables: neither is broadcast
    linked = linked.join(shown.hint("merge"), ["author_id", "name"], "left_anti")
    found = names.join(linked.hint("merge"), "name").select("resource_id", (F.col("p") + 1).cast("int").alias("author_pos"), "author_id")
    return found.distinct()
