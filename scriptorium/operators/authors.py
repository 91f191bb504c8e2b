"""Author names against a registry, and attribution to the organisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from scriptorium.functions import text as X
from scriptorium.functions.similarity import jaro_winkler_udf, may_reach
from scriptorium.plans.lineage import reliable
from scriptorium.settings import Settings

# Order of the stages of the cascade.
STAGES = ("orcid", "scopus_id", "wos_id", "exact", "exact_normalized", "initial_surname", "ambiguous_initials", "ambiguous_surname", "initial_mismatch", "fuzzy")


def signatures(name: Column) -> Column:
    """Array of ``(surname, initials)`` that a name may be read as.

    With a comma the surname stands left of it (whole, and its first and last word), else it is the last or the first word.
    """
    left = X.name_words(F.substring_index(name, ",", 1))
    right = X.name_words(F.regexp_extract(name, r"(?s)^[^,]*,(.*)$", 1))
    words = X.name_words(name)
    initials = lambda ws: F.array_join(F.transform(ws, lambda w: F.substring(w, 1, 1)), "")
    sign = lambda s, i: F.struct(s.alias("surname"), i.alias("initials"))
    n = F.size(words)
    with_comma = F.array(
        sign(F.array_join(left, " "), initials(right)),
        sign(F.try_element_at(left, F.lit(1)), initials(right)),
        sign(F.try_element_at(left, F.lit(-1)), initials(right)),
    )
    without = F.array(
        sign(F.try_element_at(words, F.lit(-1)), initials(F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0))))),
        sign(F.try_element_at(words, F.lit(1)), F.when(n > 1, initials(F.slice(words, F.lit(2), F.greatest(n - 1, F.lit(0))))).otherwise(F.lit(""))),
    )
    found = F.when(name.contains(","), with_comma).otherwise(without)
    return F.array_distinct(F.filter(found, lambda s: s["surname"].isNotNull() & (s["surname"] != "")))


def name_key(name: Column) -> Column:
    """Surname and initials as one text, else the normalised name.

    Without a comma the last word is the surname, unless it alone is a single letter.
    """
    words = X.name_words(name)
    swapped = ~name.contains(",") & (F.size(words) > 1) & (F.length(F.try_element_at(words, F.lit(-1))) == 1) & (F.length(F.try_element_at(words, F.lit(1))) > 1)
    readings = signatures(name)
    s = F.when(swapped, F.try_element_at(readings, F.lit(-1))).otherwise(F.try_element_at(readings, F.lit(1)))
    return F.when(s.isNotNull(), F.concat_ws("|", s["surname"], s["initials"])).otherwise(X.normalise(name))


def richness(name: Column) -> Column:
    """How much a written name tells: comma, words longer than a letter, non-ASCII letters, length."""
    return F.struct(
        name.contains(",").cast("int").alias("comma"),
        F.size(F.filter(X.name_words(name), lambda w: F.length(w) > 1)).alias("words"),
        F.length(F.regexp_replace(name, r"[\x00-\x7F]", "")).alias("accents"),
        F.length(name).alias("length"),
    )


def merge_names(names: DataFrame) -> DataFrame:
    """``resource_id, names``: variants of one name merged in order of appearance, the richest kept, of equals the first.

    ``names``: ``resource_id, pos, name`` and, where several names may have one position, ``turn``, the order of these; what
    that leaves open the text decides.
    """
    keyed = names.filter(X.utrim(F.col("name")) != "").withColumn("key", name_key(F.col("name")))
    place = F.struct("pos", *(["turn"] if "turn" in names.columns else []), "name")
    rich = richness(F.col("name"))
    poorness = [-rich[k] for k in ("comma", "words", "accents", "length")]
    best = keyed.groupBy("resource_id", "key").agg(F.min(place).alias("place"), F.min_by("name", F.struct(*poorness, place)).alias("name"))
    return best.groupBy("resource_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]).alias("names"))


def registry_forms(registry: DataFrame) -> DataFrame:
    """``author_id, name, norm`` of every name of the registry, packed names divided."""
    names = F.concat(F.split(F.coalesce("display_name", F.lit("")), r"\|\|"), F.split(F.coalesce("other_name", F.lit("")), r"\|\||;"))
    both = F.when(F.col("surname").isNotNull() & F.col("given_name").isNotNull(), F.array(F.concat_ws(", ", "surname", "given_name"), F.concat_ws(" ", "given_name", "surname"))).otherwise(F.array().cast("array<string>"))
    rows = registry.select("author_id", F.explode(F.concat(names, both)).alias("name")).select("author_id", X.utrim(F.col("name")).alias("name")).filter("name <> ''")
    return rows.withColumn("norm", X.match_form(F.col("name"))).distinct()


def match_names(candidates: DataFrame, registry: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``name, author_id, match_type, score, matched`` of every distinct candidate (``name``).

    Cascade, the first stage that answers wins: external ids, equal text, equal normal form, unique compatible initials
    (0.98); then several with compatible initials, or several with the surname and no initials, end the search; then
    Jaro-Winkler among those with the surname and, if the candidate has initials, compatible ones. A candidate that no
    stage answers has no author. Blank candidates are left out.
    """
    names = candidates.select("name").filter(X.utrim(F.col("name")) != "").distinct().withColumn("norm", X.match_form(F.col("name")))
    forms = registry_forms(registry)
    found = []

    def stage(kind: str, rows: DataFrame, score: float) -> None:
        one = rows.groupBy("name").agg(F.min("author_id").alias("author_id"))
        found.append(one.select("name", "author_id", F.lit(kind).alias("match_type"), F.lit(score).alias("score"), F.lit(STAGES.index(kind)).alias("stage")))

    for kind, column, idk in (("orcid", "orcid", "orcid"), ("scopus_id", "scopusid", "scopus"), ("wos_id", "wos_id", "wos")):
        if column in registry.columns:
            ids = registry.select("author_id", F.col(column).alias("x")).filter("x is not null").distinct()
            stage(kind, names.withColumn("x", X.external_id(F.col("name"), idk)).join(ids, "x").select("name", "author_id"), 1.0)
    stage("exact", names.join(forms.select("author_id", "name").distinct(), "name").select("name", "author_id"), 1.0)
    stage("exact_normalized", names.filter("norm <> ''").join(forms.select("author_id", "norm").distinct(), "norm").select("name", "author_id"), 1.0)

    mine = names.select("name", "norm", F.explode(signatures(F.col("name"))).alias("s")).select("name", "norm", "s.surname", "s.initials")
    theirs = forms.select("author_id", "norm", F.explode(signatures(F.col("name"))).alias("s")).select("author_id", F.col("norm").alias("their_norm"), "s.surname", F.col("s.initials").alias("their_initials")).distinct()
    # Names with initials meet persons by surname and first initial, only those without any meet all of a surname; what is
    # asked of a surname as a whole comes from one row for each surname. So a common surname makes no pairs of its own.
    initial = lambda c: F.substring(c, 1, 1)
    first = mine.filter("initials <> ''").withColumn("letter", initial("initials"))
    known = theirs.filter("their_initials <> ''").withColumn("letter", initial("their_initials"))
    fitting = F.col("their_initials").startswith(F.col("initials")) | F.col("initials").startswith(F.col("their_initials"))
    fits = reliable(first.join(known, ["surname", "letter"]).filter(fitting).select("name", "norm", "author_id", "their_norm").distinct())  # read three times
    surnames = theirs.groupBy("surname").agg(F.min("author_id").alias("a"), F.max("author_id").alias("b"))
    by_initials = fits.groupBy("name").agg(F.min("author_id").alias("author_id"), (F.min("author_id") != F.max("author_id")).alias("several"))
    row = lambda df, kind, score, author: df.select("name", author.alias("author_id"), F.lit(kind).alias("match_type"), F.lit(score).alias("score"), F.lit(STAGES.index(kind)).alias("stage"))
    nobody = F.lit(None).cast("bigint")
    found.append(row(by_initials.filter("not several"), "initial_surname", 0.98, F.col("author_id")))
    found.append(row(by_initials.filter("several"), "ambiguous_initials", 0.0, nobody))
    bare = mine.groupBy("name").agg(F.max("initials").alias("most")).filter("most = ''").select("name")
    by_surname = mine.join(bare, "name").join(surnames, "surname").groupBy("name").agg((F.min("a") != F.max("b")).alias("several")).filter("several")
    found.append(row(by_surname, "ambiguous_surname", 0.0, nobody))
    mismatch = first.join(surnames, "surname", "left_semi").select("name").distinct().join(by_initials.select("name"), "name", "left_anti")
    found.append(row(mismatch, "initial_mismatch", 0.0, nobody))
    pool = fits.unionByName(mine.filter("initials = ''").join(theirs, "surname").select("name", "norm", "author_id", "their_norm")).distinct()
    scored = pool.filter(may_reach(F.col("norm"), F.col("their_norm"), settings.author_match_threshold)).withColumn("score", jaro_winkler_udf("norm", "their_norm"))
    best = scored.filter(F.col("score") >= settings.author_match_threshold).groupBy("name").agg(F.max_by("author_id", F.struct("score", -F.col("author_id"))).alias("author_id"), F.max("score").alias("score"))
    found.append(best.select("name", "author_id", F.lit("fuzzy").alias("match_type"), F.round("score", 4).alias("score"), F.lit(STAGES.index("fuzzy")).alias("stage")))

    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    first = every.groupBy("name").agg(F.min_by(F.struct("author_id", "match_type", "score"), F.col("stage")).alias("m"))
    out = names.select("name").join(first, "name", "left").select("name", "m.author_id", F.coalesce("m.match_type", F.lit("none")).alias("match_type"), F.coalesce("m.score", F.lit(0.0)).alias("score"))
    accepted = F.col("author_id").isNotNull() & ((F.col("match_type") != "fuzzy") | (F.col("score") >= settings.author_accept_threshold))
    return out.withColumn("matched", accepted)


def identity(author_id: Column, name: Column) -> Column:
    """What tells persons apart: ``id:`` with the number, else ``name:`` with the normalised name."""
    return F.when(author_id.isNotNull(), F.concat(F.lit("id:"), author_id.cast("string"))).otherwise(F.concat(F.lit("name:"), X.normalise(name)))


def with_surnames(registry: DataFrame) -> DataFrame:
    """``registry`` with missing surnames and given names taken from the first display name, divided at its comma."""
    shown = F.split(F.col("display_name"), r"\|\|")[0]
    left, right = X.utrim(F.substring_index(shown, ",", 1)), X.utrim(F.regexp_extract(shown, r"(?s)^[^,]*,(.*)$", 1))
    bare = F.coalesce(X.utrim(F.col("surname")), F.lit("")) == ""
    split = bare & F.coalesce(shown.contains(","), F.lit(False))
    return registry.withColumns({"surname": F.when(split, left).otherwise(F.col("surname")), "given_name": F.when(split, F.nullif(right, F.lit(""))).otherwise(F.col("given_name"))})


def ambiguous_names(records: DataFrame, matches: DataFrame, registry: DataFrame, n: int = 5) -> DataFrame:
    """``resource_id, pos, name, match_type, candidates``: names of a record that several persons could be, with them.

    Candidates are the persons of the registry that share a signature's surname, the ``n`` smallest numbers of them (a
    report for a person or a completer to choose from).
    """
    names = records.select("resource_id", F.posexplode("dc_contributor_author").alias("pos", "name"))
    open_ = names.join(matches.filter(F.col("match_type").isin("ambiguous_initials", "ambiguous_surname")).select("name", "match_type"), "name")
    theirs = registry_forms(registry).select("author_id", F.explode(signatures(F.col("name"))).alias("s")).select("author_id", "s.surname").distinct()
    first = theirs.withColumn("k", F.row_number().over(Window.partitionBy("surname").orderBy("author_id"))).filter(F.col("k") <= n).drop("k")
    mine = open_.select("name").distinct().select("name", F.explode(signatures(F.col("name"))).alias("s")).select("name", "s.surname").distinct()
    meant = mine.join(first, "surname").groupBy("name").agg(F.slice(F.array_sort(F.collect_set("author_id")), 1, n).alias("candidates"))
    return open_.join(meant, "name").select("resource_id", "pos", "name", "match_type", "candidates")


def english_names(units: DataFrame, translations: DataFrame) -> DataFrame:
    """``id, name``: the English name of each unit, else what its Czech name is translated to, else null.

    ``units``: ``id, name_en, name_cs``; ``translations``: ``czech, english``, compared in normal form. Names that begin
    with ``EN_`` stand for none.
    """
    good = (X.utrim(F.col("name_en")) != "") & ~F.col("name_en").startswith("EN_")
    known = translations.select(X.normalise(F.col("czech")).alias("key"), "english").groupBy("key").agg(F.min("english").alias("english"))
    rows = units.select("id", F.when(good, X.utrim(F.col("name_en"))).alias("name"), X.normalise(F.col("name_cs")).alias("key"))
    return rows.join(known, "key", "left").select("id", F.coalesce("name", "english").alias("name"))


def person_data(registry: DataFrame, units: DataFrame, translations: DataFrame) -> DataFrame:
    """``author_id, faculties, ou`` from the workplaces of a person: faculties translated and in order, the longest real unit.

    ``units``: ``id, name, parent_id``; a unit without a parent is a faculty or the house itself, one with a parent is real.
    A faculty field may hold several, divided by ``||``; what is no name of a unit without a parent is left out.
    """
    tops = units.filter("parent_id is null").select(X.normalise(F.col("name")).alias("key"), F.col("name").alias("faculty"))
    czech = translations.select(X.normalise(F.col("czech")).alias("key"), F.col("english").alias("faculty")).join(tops.select("faculty"), "faculty", "left_semi").select("key", "faculty")
    names = tops.unionByName(czech).groupBy("key").agg(F.min("faculty").alias("faculty"))
    told = registry.select("author_id", F.explode(X.split_display(F.col("faculty"))).alias("x")).select("author_id", X.normalise(F.col("x")).alias("key"))
    by = told.join(names, "key").groupBy("author_id").agg(F.array_sort(F.collect_set("faculty")).alias("faculties"))
    real = registry.select("author_id", F.col("organization_id").alias("id")).join(units.filter("parent_id is not null").select("id", "name"), "id")
    longest = real.groupBy("author_id").agg(F.max_by("name", F.struct(F.length("name"), "name")).alias("ou"))
    every = registry.select("author_id").distinct()
    return every.join(by, "author_id", "left").join(longest, "author_id", "left").select("author_id", F.coalesce("faculties", F.array().cast("array<string>")).alias("faculties"), "ou")


def author_records(records: DataFrame, people: DataFrame, attributions: DataFrame, ambiguous: DataFrame, warnings: DataFrame) -> DataFrame:
    """``resource_id, names, faculties, ous, flags, needs_llm, status``: what the author stage says of every record.

    ``flags`` is JSON: names that several persons could be, persons whose found faculty isn't their usual one, those
    without any, whether the WoS texts could be read, and the ``duplicates`` that the record's own flags already had. A
    record needs a completer if a WoS text has no block, a name is ambiguous or a person has no workplace.
    ``warnings``: ``resource_id, ok`` of WoS texts.
    """
    person = F.struct("author_id", "faculty")
    told = attributions.groupBy("resource_id").agg(F.array_sort(F.collect_list(F.when(F.col("conflict"), person))).alias("conflicts"), F.array_sort(F.collect_list(F.when(F.col("method") == "unresolved", F.col("author_id")))).alias("unresolved"))
    open_ = ambiguous.groupBy("resource_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("ambiguous"))
    rows = author_payload(records, people, attributions).join(told, "resource_id", "left").join(open_, "resource_id", "left").join(warnings.select("resource_id", F.col("ok").alias("wos_ok")), "resource_id", "left")
    rows = rows.join(records.select("resource_id", F.get_json_object("author_flags", "$.duplicates").alias("duplicates")), "resource_id", "left")
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    needs = ~F.coalesce("wos_ok", F.lit(True)) | some("ambiguous") | some("unresolved")
    flags = F.to_json(F.struct(F.nullif("ambiguous", F.array().cast("array<string>")).alias("ambiguous"), F.when(some("conflicts"), F.col("conflicts")).alias("conflicts"), F.when(some("unresolved"), F.col("unresolved")).alias("unresolved"), F.coalesce("wos_ok", F.lit(True)).alias("wos_ok"), "duplicates"))
    return rows.select("resource_id", "names", "faculties", "ous", flags.alias("flags"), needs.alias("needs_llm"), F.lit("processed").alias("status"))


def resolve_authors(records: DataFrame, matches: DataFrame) -> DataFrame:
    """``resource_id, author_id, name, pos``: each matched person of a record once, under the first name that matches."""
    names = records.select("resource_id", F.posexplode("dc_contributor_author").alias("pos", "name"))
    hits = names.join(matches.filter("matched").select("name", "author_id"), "name")
    return hits.groupBy("resource_id", "author_id").agg(F.min_by("name", "pos").alias("name"), F.min("pos").alias("pos"))


def default_affiliations(registry: DataFrame, units: DataFrame) -> DataFrame:
    """``author_id, faculty, ou``: the faculty of the registry, else that above the unit; the unit with the longest name.

    ``units``: ``id, name, parent_id``.
    """
    parents = units.select(F.col("id").alias("parent_id"), F.col("name").alias("above"))
    known = units.select("id", F.col("name").alias("unit"), "parent_id").join(parents, "parent_id", "left")
    rows = registry.join(known, registry["organization_id"] == known["id"], "left").select("author_id", F.coalesce(F.nullif(F.trim("faculty"), F.lit("")), F.col("above")).alias("faculty"), F.when(F.col("parent_id").isNotNull(), F.col("unit")).alias("ou"))
    return rows.groupBy("author_id").agg(F.min("faculty").alias("faculty"), F.max_by("ou", F.struct(F.length("ou"), "ou")).alias("ou"))


def attribute(people: DataFrame, workplaces: DataFrame, defaults: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``resource_id, author_id, faculty, ou, method, confidence, conflict`` of every resolved person of a record.

    ``people``: ``resource_id, author_id, pos``; ``workplaces``: ``resource_id, author_id, source, faculty, ou`` found in
    affiliations (Scopus before WoS); ``defaults``: ``author_id, faculty, ou``. Those without a found workplace take the
    dominant one of the record if its share of all is at least ``cohort_share`` and their default faculty agrees
    (confidence 0.85 x share), else their default (0.70), else none (0).
    """
    order = F.when(F.col("source") == "scopus", 0).otherwise(1)
    seen = workplaces.groupBy("resource_id", "author_id").agg(F.min_by(F.struct("source", "faculty", "ou"), F.struct(order, "faculty", "ou")).alias("w"))
    rows = people.join(seen, ["resource_id", "author_id"], "left").join(defaults.select("author_id", F.col("faculty").alias("default_faculty"), F.col("ou").alias("default_ou")), "author_id", "left")
    whole = rows.groupBy("resource_id").agg(F.count("*").alias("people"))
    pairs = rows.filter("w is not null").groupBy("resource_id", F.col("w.faculty").alias("faculty"), F.col("w.ou").alias("ou")).agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    top = pairs.groupBy("resource_id").agg(F.max_by(F.struct("faculty", "ou", "n"), F.struct("n", -F.col("first"))).alias("top"))
    rows = rows.join(whole, "resource_id").join(top, "resource_id", "left")
    share = F.col("top.n") / F.col("people")
    cohort = F.col("w").isNull() & (share >= settings.cohort_share) & (F.col("default_faculty") == F.col("top.faculty"))
    pick = lambda found, group, default: F.when(F.col("w").isNotNull(), found).when(cohort, group).otherwise(default)
    return rows.select(
        "resource_id", "author_id",
        pick(F.col("w.faculty"), F.col("top.faculty"), F.col("default_faculty")).alias("faculty"),
        pick(F.col("w.ou"), F.col("top.ou"), F.col("default_ou")).alias("ou"),
        pick(F.concat(F.lit("verified_"), F.col("w.source")), F.lit("cohort"), F.when(F.col("default_faculty").isNotNull(), "default").otherwise("unresolved")).alias("method"),
        F.round(pick(F.lit(1.0), 0.85 * share, F.when(F.col("default_faculty").isNotNull(), 0.70).otherwise(0.0)), 4).alias("confidence"),
        F.coalesce(F.col("w").isNotNull() & (F.col("default_faculty") != F.col("w.faculty")), F.lit(False)).alias("conflict"),
    )


def author_payload(records: DataFrame, people: DataFrame, attributions: DataFrame) -> DataFrame:
    """``resource_id, names, faculties, ous``: three aligned arrays in the order of the authors; null where nobody is known."""
    rows = people.join(attributions, ["resource_id", "author_id"], "left")
    listed = F.array_sort(F.collect_list(F.struct("pos", "name", F.coalesce("faculty", F.lit("")).alias("faculty"), F.coalesce("ou", F.lit("")).alias("ou"))))
    by = rows.groupBy("resource_id").agg(listed.alias("x"))
    return records.select("resource_id").join(by, "resource_id", "left").select("resource_id", *[F.transform("x", (lambda k: lambda r: r[k])(k)).alias(n) for k, n in (("name", "names"), ("faculty", "faculties"), ("ou", "ous"))])


def compare_sets(rows: DataFrame, left: str, right: str) -> DataFrame:
    """``agreement, n, percent`` of two arrays of names compared without accents and case: one of six classes."""
    plain = lambda c: F.array_distinct(F.transform(F.coalesce(c, F.array().cast("array<string>")), X.normalise))
    a, b = plain(left), plain(right)
    kind = (
        F.when((F.size(a) == 0) & (F.size(b) == 0), "both_empty").when(F.size(a) == 0, "only_right").when(F.size(b) == 0, "only_left")
        .when((F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0), "equal").when(F.arrays_overlap(a, b), "partial").otherwise("different")
    )
    by = rows.select(kind.alias("agreement")).groupBy("agreement").agg(F.count("*").alias("n"))
    return by.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 2))


def source_lists(records: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """``resource_id, source, pos, turn, name``: authors as WoS, Scopus and the repository (``repo``) give them.

    Where a record has a merge history, each source's authors are those of the merged rows with its tag; else the current
    authors go to WoS or Scopus if the record has exactly one of the tags. The repository list is WoS, Scopus, current.
    Names of several merged rows share positions: ``turn`` says which row was merged first (time, then number; null for
    current authors). Of copies of one row merged into one record the earliest counts.
    """
    tag = lambda c, words: F.coalesce(F.exists(c, lambda x: F.lower(x).rlike(words)), F.lit(False))
    names = lambda df, key, *cols: df.select(F.col(key).cast("bigint").alias("resource_id"), *cols, F.posexplode("dc_contributor_author").alias("pos", "name"))
    tags = (tag("utb_source", "wos|wok").alias("w"), tag("utb_source", "scopus").alias("s"))
    current = names(records, "resource_id", *tags, F.lit(None).cast("struct<merged_at: timestamp, merged_id: bigint>").alias("turn"))
    if history is None:
        past = current.limit(0)
    else:
        merged_at = F.col("dedup_merged_at") if "dedup_merged_at" in history.columns else F.lit(None)
        copy = F.struct(merged_at.cast("timestamp").alias("merged_at"), "utb_source", "dc_contributor_author")
        once = history.filter("resource_id <> dedup_kept_resource_id").groupBy("resource_id", "dedup_kept_resource_id").agg(F.min(copy).alias("x")).select("resource_id", "dedup_kept_resource_id", "x.*")
        past = names(once, "dedup_kept_resource_id", *tags, F.struct("merged_at", F.col("resource_id").cast("bigint").alias("merged_id")).alias("turn"))
    known = past.select("resource_id").distinct()
    alone = current.join(known, "resource_id", "left_anti").filter(F.col("w") != F.col("s"))
    tagged = past.unionByName(alone)
    wos, scopus = tagged.filter("w").select("resource_id", F.lit("wos").alias("source"), "pos", "turn", "name"), tagged.filter("s").select("resource_id", F.lit("scopus").alias("source"), "pos", "turn", "name")
    step = F.when(F.col("source") == "wos", 0).otherwise(1_000_000_000)
    repo = wos.unionByName(scopus).select("resource_id", (F.col("pos") + step).alias("pos"), "turn", "name").unionByName(current.select("resource_id", (F.col("pos") + 2_000_000_000).alias("pos"), "turn", "name"))
    return wos.unionByName(scopus).unionByName(repo.select("resource_id", F.lit("repo").alias("source"), "pos", "turn", "name"))


#: Room for the positions of one source in a merged order.
_SHELF = 10**15


def author_inputs(records: DataFrame, blocks: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """``resource_id, names``: one list of authors from repository, WoS, Scopus, and both kinds of affiliation blocks, in this order."""
    lists = source_lists(records, history)
    order = F.when(F.col("source") == "repo", 0).when(F.col("source") == "wos", 1).otherwise(2)
    rows = lists.select("resource_id", (order * _SHELF + F.col("pos")).alias("pos"), "turn", "name")
    place = F.when(F.col("source") == "scopus", 3).otherwise(4)
    named = blocks.filter("author is not null").select("resource_id", (place * _SHELF + F.col("pos")).alias("pos"), F.col("author").alias("name"))
    return merge_names(rows.unionByName(named, allowMissingColumns=True))


def align_blocks(records: DataFrame, blocks: DataFrame) -> DataFrame:
    """``resource_id, pos, name, source, affiliation``: the first affiliation of each author in each source, by name key."""
    mine = records.select("resource_id", F.posexplode("dc_contributor_author").alias("pos", "name")).withColumn("key", name_key(F.col("name")))
    first = blocks.filter("author is not null").groupBy("resource_id", name_key(F.col("author")).alias("key"), "source").agg(F.min_by("affiliation", F.struct("pos", "affiliation")).alias("affiliation"))
    return mine.join(first, ["resource_id", "key"]).select("resource_id", "pos", "name", "source", "affiliation")
