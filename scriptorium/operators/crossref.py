"""Citation metadata of one work as displayed fields, from JSON with an explicit schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scriptorium.functions import text as X

_DATE = "struct<`date-parts`:array<array<int>>>"
SCHEMA = (
    "struct<title:array<string>,abstract:string,publisher:string,`container-title`:array<string>,volume:string,issue:string,page:string,DOI:string,type:string,language:string,"
    "ISSN:array<string>,ISBN:array<string>,subject:array<string>,URL:string,author:array<struct<family:string,given:string,name:string>>,"
    "funder:array<struct<name:string,award:array<string>>>,license:array<struct<URL:string>>,link:array<struct<URL:string>>,`issn-type`:array<struct<value:string,type:string>>,"
    f"`published-print`:{_DATE},`published-online`:{_DATE},published:{_DATE},issued:{_DATE}>"
)


def iso_date(date: Column) -> Column:
    """First list of date parts, padded and joined by hyphens."""
    parts = F.try_element_at(date["date-parts"], F.lit(1))
    return F.nullif(F.array_join(F.transform(F.filter(parts, lambda p: p.isNotNull()), lambda p: F.when(F.length(p.cast("string")) < 2, F.lpad(p.cast("string"), 2, "0")).otherwise(p.cast("string"))), "-"), F.lit(""))


def _joined(col: Column) -> Column:
    return F.nullif(F.array_join(F.filter(F.transform(col, X.utrim), lambda x: x != ""), "||"), F.lit(""))


def authors(col: Column) -> Column:
    """``family, given`` or the name, joined."""
    one = lambda a: F.coalesce(F.nullif(F.concat_ws(", ", F.nullif(a["family"], F.lit("")), F.nullif(a["given"], F.lit(""))), F.lit("")), a["name"])
    return _joined(F.transform(col, one))


def funders(col: Column) -> Column:
    """Name, with awards in brackets."""
    one = lambda f: F.when(F.size(f["award"]) > 0, F.concat(f["name"], F.lit(" ("), F.array_join(f["award"], ", "), F.lit(")"))).otherwise(f["name"])
    return _joined(F.transform(col, one))


def work_fields(works: DataFrame, column: str = "message") -> DataFrame:
    """``works`` with one column for each displayed field; JSON that can't be read gives nulls.

    The date of issue falls back from print to online to published to issued. A page range is divided at its first hyphen.
    """
    df = works.withColumn("__m", F.from_json(column, SCHEMA))
    m = F.col("__m")
    pages = F.split(m["page"], "-", 2)
    printed, online, published, issued = (iso_date(m[k]) for k in ("published-print", "published-online", "published", "issued"))
    fields = {
        "dc_title": _joined(m["title"]), "dc_description_abstract": X.strip_jats(m["abstract"]), "dc_publisher": X.utrim(m["publisher"]), "dc_relation_ispartof": _joined(m["container-title"]),
        "utb_relation_volume": m["volume"], "utb_relation_issue": m["issue"], "dc_identifier_doi": m["DOI"], "dc_type": m["type"], "dc_language": m["language"], "dc_identifier_issn": _joined(m["ISSN"]),
        "dc_identifier_isbn": _joined(m["ISBN"]), "dc_subject": _joined(m["subject"]), "dc_identifier_uri": m["URL"], "dc_contributor_author": authors(m["author"]), "funders": funders(m["funder"]),
        "dc_rights_uri": _joined(F.transform(m["license"], lambda x: x["URL"])), "links": _joined(F.transform(m["link"], lambda x: x["URL"])),
        "issn_types": _joined(F.transform(m["issn-type"], lambda x: F.concat(x["value"], F.lit(" ("), x["type"], F.lit(")")))),
        "dc_date_issued": F.coalesce(printed, online, published, issued), "dc_date_available": F.coalesce(online, published), "dc_citation_spage": F.try_element_at(pages, F.lit(1)), "dc_citation_epage": F.try_element_at(pages, F.lit(2)),
    }
    return df.select(*works.columns, *[c.alias(k) for k, c in fields.items()])
