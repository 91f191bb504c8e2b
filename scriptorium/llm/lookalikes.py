"""Visually identical text: one consistent form through code points.

Plan: a regular expression in the scan picks the elements that hold any character of the mapping (lossless: no other
element can change). Their text is exploded to positioned code points, broadcast-joined with decomposition and look-alike
mappings, combining marks are ordered by class within each base character, recomposed, and the texts rebuilt. The
mappings are built by rule from the Unicode tables and hold a few thousand entries, whatever the input.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from scriptorium.llm import mojibake

# Letters of other alphabets that look like a Latin letter (symbols such as alpha, beta, omega do not).
CYRILLIC_LOOKALIKES = "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX ҮY ԌG ԚQ ԜW ӀI аa еe ѕs іi јj оo рp сc уy хx ѵv үy һh ӏl ԁd ԛq ԝw"
GREEK_LOOKALIKES = "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ͿJ οo νv ϲc ϳj"
ARMENIAN_LOOKALIKES = "ՍU ՏS ՕO աw հh յj ոn ռn սu ցg օo"
CHEROKEE_LOOKALIKES = "ᎠD ᎡR ᎢT ᎥI ᎪA ᎫJ ᎬE ᎳW ᎷM ᎻH ᎽY ᏀG ᏃZ ᏔW ᏕS ᏙV ᏚS ᏞL ᏟC ᏢP ᏦK ᏩG ᏴB"
LOOKALIKES = {pair[0]: pair[1] for pair in " ".join((CYRILLIC_LOOKALIKES, GREEK_LOOKALIKES, ARMENIAN_LOOKALIKES, CHEROKEE_LOOKALIKES)).split()}
# Hyphens that stand in for the ordinary one (dashes are ordinary text).
HYPHENS = "‐‑"

_COMPAT = ("<wide>", "<narrow>", "<font>", "<noBreak>")
# Conjoining letters of the Korean alphabet (first and last code point) and the syllables made of them.
LEADS, VOWELS, TAILS, SYLLABLES = (0x1100, 0x1112), (0x1161, 0x1175), (0x11A8, 0x11C2), (0xAC00, 0xD7A3)


def _hidden(ch: str) -> bool:
    return unicodedata.category(ch) == "Cf" or "\ufe00" <= ch <= "\ufe0f" or "\U000e0100" <= ch <= "\U000e01ef" or ch == "\u034f"


@lru_cache(maxsize=1)
def mapping() -> list[tuple[str, list[str], list[int], str]]:
    """(character, its decomposition, combining classes, kind) by rule.

    Kinds: ``canonical`` (a composed letter: ordinary), ``single`` (a letter that is never the composed form), ``mark``, ``compat`` (full width, ligature, font variant),
    ``blank`` (a space other than U+0020), ``hidden`` (no visible form), ``hyphen``.
    """
    out = []
    for cp in range(0x80, sys.maxunicode + 1):
        if SYLLABLES[0] <= cp <= SYLLABLES[1] or 0xD800 <= cp <= 0xDFFF:  # syllables are composed by rule
            continue
        ch = chr(cp)
        cat = unicodedata.category(ch)
        if cat == "Cn":
            continue
        how = unicodedata.decomposition(ch)
        if _hidden(ch):
            out.append((ch, [], [], "hidden"))
        elif cat == "Zs":
            out.append((ch, [" "], [0], "blank"))
        elif ch in HYPHENS:
            out.append((ch, ["-"], [0], "hyphen"))
        elif how.startswith(_COMPAT) or "ﬀ" <= ch <= "ﬆ":
            parts = unicodedata.normalize("NFKD", ch)
            out.append((ch, list(parts), [unicodedata.combining(p) for p in parts], "compat"))
        elif cat in ("Mn", "Mc", "Me"):
            parts = unicodedata.normalize("NFD", ch)
            out.append((ch, list(parts), [unicodedata.combining(p) for p in parts], "mark"))
        elif how and not how.startswith("<"):
            parts = unicodedata.normalize("NFD", ch)
            kind = "canonical" if unicodedata.normalize("NFC", ch) == ch else "single"
            out.append((ch, list(parts), [unicodedata.combining(p) for p in parts], kind))
    return out


@lru_cache(maxsize=1)
def compositions() -> dict[str, str]:
    """Base and mark to their primary composite."""
    out = {}
    for cp in range(0x80, sys.maxunicode + 1):
        ch = chr(cp)
        how = unicodedata.decomposition(ch)
        if how and not how.startswith("<") and len(parts := how.split()) == 2:
            pair = "".join(chr(int(p, 16)) for p in parts)
            if unicodedata.normalize("NFC", pair) == ch:
                out[pair] = ch
    return out


#: Characters that no mapping changes and that are common in texts; look-alikes are looked for apart from these.
_PLAIN = r"[^\x00-\x9F\xA1-\xAC\xAE-\x{24F}\x{388}-\x{3CE}\x{400}-\x{482}\x{48A}-\x{52F}\x{2012}-\x{2027}\x{20A0}-\x{20BF}\x{FFFD}]"


_ALIKE = "[" + "".join(LOOKALIKES) + "]"
_LATIN = r"[A-Za-zÀ-ɏ]"


def suspicious(text: Column) -> Column:
    """Lossless test: false only for texts that no rule can change."""
    return (F.octet_length(text) > F.char_length(text)) & (text.rlike(_PLAIN) | (text.rlike(_ALIKE) & text.rlike(_LATIN)))


def _mapping_frame(spark: SparkSession) -> DataFrame:
    schema = "cp string, parts array<string>, classes array<int>, kind string"
    return spark.createDataFrame(mapping(), schema)


def _of(ch: Column, *ranges: tuple[int, int]) -> Column:
    """Whether a character lies in one of the ranges of code points."""
    out = F.lit(False)
    for low, high in ranges:
        out = out | ch.between(chr(low), chr(high))
    return out


def _syllable(base: Column, part: Column) -> Column:
    """Korean syllable of a leading consonant and a vowel, or of a syllable without a tail and a tail; else null."""
    b, p = F.ascii(base), F.ascii(part)
    begun = (b - LEADS[0]) * 588 + (p - VOWELS[0]) * 28 + SYLLABLES[0]
    open_ = _of(base, SYLLABLES) & ((b - SYLLABLES[0]) % 28 == 0)
    code = F.when(_of(base, LEADS) & _of(part, VOWELS), begun).when(open_ & _of(part, TAILS), b + p - (TAILS[0] - 1))
    return F.decode(F.unhex(F.hex(code.cast("bigint"))), "UTF-16BE")


def _compose(group: Column) -> Column:
    """Canonical composition of one base character with its marks, which are in canonical order.

    Folds the marks into the base where a composite exists and no mark of the same or a higher class was left between.
    """
    pairs = F.str_to_map(F.lit("\n".join(f"{a}\t{b}" for a, b in compositions().items())), F.lit("\n"), F.lit("\t"))  # one literal
    start = F.struct(F.element_at(group, 1)["part"].alias("base"), F.lit("").alias("rest"), F.lit(0).alias("last"))

    def fold(acc: Column, mark: Column) -> Column:
        free = (acc["rest"] == "") | (acc["last"] < mark["ccc"])
        made = F.when(free & _of(mark["part"], VOWELS, TAILS), _syllable(acc["base"], mark["part"])).when(free, F.try_element_at(pairs, F.concat(acc["base"], mark["part"])))
        return F.when(made.isNotNull(), F.struct(made.alias("base"), acc["rest"].alias("rest"), acc["last"].alias("last"))).otherwise(
            F.struct(acc["base"].alias("base"), F.concat(acc["rest"], mark["part"]).alias("rest"), mark["ccc"].alias("last"))
        )

    return F.aggregate(F.slice(group, 2, F.greatest(F.size(group) - 1, F.lit(0))), start, fold, lambda acc: F.concat(acc["base"], acc["rest"]))


_KEYS = ["row_id", "field_name", "value_pos"]
_PART_KEYS = [*_KEYS, "part_no"]


def _parts(elements: DataFrame) -> DataFrame:
    """Texts that may change, cut into words (letters, marks and hidden characters) and single other characters.

    The alphabets of word and text are known by then; ``odd`` tells which parts may change.
    """
    some = elements.select(*_KEYS, "text").filter(F.col("row_id").isNotNull() & suspicious(F.col("text"))).dropDuplicates(_KEYS)
    other = rf"[\p{{L}}&&[^\p{{IsLatin}}]&&[^{_ALIKE[1:-1]}]]"
    inside = "[\\p{L}\\p{M}\\p{Cf}\U0001d400]"  # a letter beyond the first plane makes the engine look behind by whole characters
    text = F.col("text")
    parts = some.select(
        *_KEYS,
        (text.rlike(_LATIN) & ~text.rlike(other)).alias("latin_text"),
        F.posexplode(F.split("text", rf"(?![\uDC00-\uDFFF])(?:(?<!{inside})|(?!{inside}))")).alias("part_no", "part_text"),
    )
    part = F.col("part_text")
    latin_word = part.rlike(_LATIN) | (F.col("latin_text") & ~part.rlike(other))
    alike = part.rlike(_ALIKE) & latin_word
    return parts.select(*_PART_KEYS, "part_text", alike.alias("alike"), (part.rlike(_PLAIN) | alike).alias("odd"))


def _rebuilt(parts: DataFrame) -> DataFrame:
    """``stands, changed, part_text`` of the odd parts, through their code points."""
    spark = parts.sparkSession
    points = parts.filter("odd").select(*_PART_KEYS, "alike", F.posexplode(F.split("part_text", "")).alias("pos", "cp")).filter(F.col("cp") != "")
    table = F.broadcast(_mapping_frame(spark))
    looks = F.broadcast(spark.createDataFrame(list(LOOKALIKES.items()), "cp string, latin string"))
    rows = points.join(table, "cp", "left").join(looks, "cp", "left").withColumn("swap", F.col("alike") & F.col("latin").isNotNull())
    stands = F.col("swap") | F.coalesce(~F.col("kind").isin("canonical", "mark"), F.lit(False))
    made_of = F.when(F.col("swap"), F.array("latin")).otherwise(F.coalesce("parts", F.array("cp")))
    classes = F.when(F.col("swap"), F.array(F.lit(0))).otherwise(F.coalesce("classes", F.array(F.lit(0))))
    flat = rows.select(*_PART_KEYS, "pos", "cp", stands.alias("stands"), F.posexplode_outer(F.arrays_zip(made_of.alias("part"), classes.alias("ccc"))).alias("sub", "x"))
    # A group is a base character with the marks and Korean vowels and tails behind it; hidden characters left no part and join the group before.
    starts = F.when((F.coalesce("x.ccc", F.lit(0)) == 0) & F.col("x").isNotNull() & ~_of(F.col("x.part"), VOWELS, TAILS), 1).otherwise(0)
    flat = flat.withColumn("group", F.sum(starts).over(Window.partitionBy(*_PART_KEYS).orderBy("pos", "sub")))
    piece = F.when(F.col("x").isNotNull(), F.struct(F.col("x.ccc").alias("ccc"), "pos", "sub", F.col("x.part").alias("part")))
    written = F.collect_list(F.when(F.col("sub").isNull() | (F.col("sub") == 0), F.struct("pos", "cp")))
    groups = flat.groupBy(*_PART_KEYS, "group").agg(F.max("stands").alias("stands"), F.sort_array(F.collect_list(piece)).alias("marks"), F.sort_array(written).alias("written"))
    made = F.when(F.size("marks") == 0, F.lit("")).when(F.size("marks") == 1, F.element_at("marks", 1)["part"]).otherwise(_compose(F.col("marks")))
    groups = groups.select(*_PART_KEYS, "group", "stands", made.alias("made"), F.array_join(F.transform("written", lambda w: w["cp"]), "").alias("before"))
    groups = groups.withColumn("changed", F.col("stands") | (F.col("made") != F.col("before")))
    return groups.groupBy(*_PART_KEYS).agg(F.max("stands").alias("stands"), F.max("changed").alias("changed"), _joined_up("group", "made").alias("part_text"))


def _joined_up(order: str, text: str) -> Column:
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda g: g[text]), "")


def unify_text(elements: DataFrame) -> DataFrame:
    """``row_id, field_name, value_pos, stand_in, unified`` of the ``elements`` (``..., text``) whose form changes.

    Marks are composed, full-width forms, ligatures and font variants replaced, blanks other than U+0020 become it,
    hidden characters go, and look-alike letters of another alphabet become Latin within a word that also has Latin
    letters, or that stands in a text whose other letters are all Latin. Ordinary text stays as it is. ``stand_in``
    tells whether anything but composition changed.
    Null ids and texts and empty texts give no rows; repeated rows are treated as one; an empty table gives an empty one; texts of any
    length are handled whole. Other columns are ignored.
    """
    parts = _parts(elements)
    same = parts.filter("not odd").select(*_PART_KEYS, F.lit(False).alias("stands"), F.lit(False).alias("changed"), "part_text")
    every = _rebuilt(parts).unionByName(same).groupBy(*_KEYS)
    return every.agg(F.max("changed").alias("changed"), F.max("stands").alias("stand_in"), _joined_up("part_no", "part_text").alias("unified")).filter("changed").drop("changed")


def elements_of(records: DataFrame, fields: tuple[str, ...], row_id: str = "resource_id") -> DataFrame:
    """``row_id, field_name, value_pos, text`` of array fields."""
    none = F.array().cast("array<struct<field_name:string,value_pos:int,text:string>>")

    def listed(field: str) -> Column:
        return F.transform(F.col(f"`{field}`"), lambda x, i: F.struct(F.lit(field).alias("field_name"), (i + 1).cast("int").alias("value_pos"), x.alias("text")))

    entries = F.flatten(F.array(*[F.coalesce(listed(f), none) for f in fields]))
    return records.select(F.col(f"`{row_id}`").cast("bigint").alias("row_id"), F.inline(entries))


def p5_found(records: DataFrame) -> DataFrame:
    """Elements with stand-in or hidden characters or letters not composed; wrongly decoded ones are another problem's."""
    elements = elements_of(records, ("dc_title", "dc_description_abstract", "utb_scopus_affiliation"))
    found = _rebuilt(_parts(elements)).filter("changed").select(F.col("row_id").alias("resource_id"), "field_name", "value_pos").distinct()
    titles = records.select("resource_id", F.when(F.exists("dc_title", suspicious), F.col("dc_title")).alias("dc_title"))
    damaged = mojibake.repair_encoding(titles, ("dc_title",), counts=mojibake.corpus_counts(records, ("dc_title",)))
    damaged = damaged.select(F.col("row_id").alias("resource_id"), "field_name", "value_pos")
    return found.join(damaged, ["resource_id", "field_name", "value_pos"], "left_anti")
