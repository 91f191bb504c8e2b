"""Record schema, type mapping, and the boundary between dotted and plain column names."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Column type names of the relational source and their Spark types.
SCALARS = {
    "bigint": T.LongType(), "int8": T.LongType(), "integer": T.IntegerType(), "int4": T.IntegerType(), "smallint": T.ShortType(),
    "text": T.StringType(), "character varying": T.StringType(), "varchar": T.StringType(), "character": T.StringType(), "boolean": T.BooleanType(), "bool": T.BooleanType(),
    "real": T.FloatType(), "float4": T.FloatType(), "double precision": T.DoubleType(), "float8": T.DoubleType(), "numeric": T.DecimalType(38, 0),
    "timestamp without time zone": T.TimestampNTZType(), "timestamp with time zone": T.TimestampType(), "timestamptz": T.TimestampType(), "timestamp": T.TimestampNTZType(),
    "date": T.DateType(), "json": T.StringType(), "jsonb": T.StringType(), "uuid": T.StringType(),
}

RECORD_ARRAYS = (
    "dc_title", "dc_contributor_author", "dc_description_abstract", "dc_identifier_doi", "dc_identifier_issn", "dc_identifier_isbn", "dc_type", "dc_date_issued",
    "dc_date_accessioned", "dc_publisher", "dc_relation_ispartof", "utb_contributor_internalauthor", "utb_faculty", "utb_ou", "utb_source", "utb_identifier_wok",
    "utb_identifier_scopus", "utb_identifier_obdid", "utb_wos_affiliation", "utb_scopus_affiliation", "utb_fulltext_affiliation", "utb_fulltext_dates",
)


def spark_type(name: str) -> T.DataType:
    """Spark type of a relational type name; arrays are written ``T[]`` or ``_T``; an unknown type is an error."""
    name = " ".join(name.strip().lower().split())
    if name.endswith("[]") or name.startswith("_"):
        return T.ArrayType(spark_type(name.removesuffix("[]").removeprefix("_")))
    bare = re.sub(r"\s*\(.*\)", "", name)
    if bare not in SCALARS:
        raise ValueError(f"no Spark type for {name!r}")
    return SCALARS[bare]


def build_schema(columns: list[tuple[str, str, bool]]) -> T.StructType:
    """Schema of ``(name, relational type, nullable)``."""
    return T.StructType([T.StructField(n, spark_type(t), nullable) for n, t, nullable in columns])


def undotted(df: DataFrame) -> DataFrame:
    """Dots in column names become underscores; two columns that would clash are an error."""
    names = [c.replace(".", "_") for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError("column names clash without dots")
    return df.toDF(*names)


def as_array(df: DataFrame, name: str) -> Column:
    """The column as an array of strings, whether it came as a scalar or an array; null stays null."""
    col = F.col(f"`{name}`")
    if dict(df.dtypes)[name].startswith("array"):
        return col
    return F.when(col.isNotNull(), F.array(col.cast("string")))


def coerce_arrays(df: DataFrame, names: tuple[str, ...] = RECORD_ARRAYS) -> DataFrame:
    """All multi-valued fields that ``df`` has as arrays."""
    return df.withColumns({n: as_array(df, n) for n in names if n in df.columns})


def first(col: Column) -> Column:
    """First element, null where there is none."""
    return F.try_element_at(col, F.lit(1))
