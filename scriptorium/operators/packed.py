"""Several values packed into one field: one row per value with its position.

The tokenizer is a finite-state machine over each text; nothing here shuffles but the removal of events delivered twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from scriptorium.functions.packed import AFFILIATIONS, IDENTIFIERS, NAMES, UNITS, Dialect, split_values

_OUT = pa.schema([("field_name", pa.string()), ("row_id", pa.int64()), ("value_pos", pa.int32()), ("single_value", pa.string()), ("packed", pa.bool_())])
_DDL = "field_name string, row_id bigint, value_pos int, single_value string, packed boolean"

# How the fields of the change buffer that may hold several values pack them.
BUFFER_DIALECTS = {"dc.contributor.author": NAMES, "dc.identifier.issn": IDENTIFIERS, "utb.faculty": UNITS, "utb.ou": UNITS}


def split_packed(texts: DataFrame, dialects: dict[str, Dialect]) -> DataFrame:
    """``field_name, row_id, value_pos, single_value, packed`` from ``field_name, row_id, dialect, elements``.

    ``elements`` is an array of texts, read with ``dialects[dialect]``; an unknown dialect keeps every text whole.
    Positions count through the whole field. ``packed`` tells whether any one element held two or more values.
    A null array, null, empty and blank elements give no rows; repeated input rows give repeated results; the order of
    equal values is kept. Other columns are ignored.
    """

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fields: list = []
            rows: list = []
            places: list = []
            values: list = []
            packed: list = []
            for field, rid, kind, elements in zip(*(b.column(i).to_pylist() for i in range(4))):
                split = [split_values(e, dialects.get(kind, Dialect(strong=""))) for e in elements or ()]
                several, pos = any(len(v) > 1 for v in split), 0
                for one in split:
                    for value in one:
                        pos += 1
                        fields.append(field)
                        rows.append(rid)
                        places.append(pos)
                        values.append(value)
                        packed.append(several)
            yield pa.RecordBatch.from_arrays([pa.array(fields, pa.string()), pa.array(rows, pa.int64()), pa.array(places, pa.int32()), pa.array(values, pa.string()), pa.array(packed, pa.bool_())], schema=_OUT)

    return texts.select("field_name", F.col("row_id").cast("bigint"), "dialect", "elements").mapInArrow(tokenise, _DDL)


def _may_hold_several(elements: Column) -> Column:
    """Lossless test before any text leaves the JVM: no value ends without one of these characters."""
    return F.exists(elements, lambda e: e.rlike(r"[|;\n\t,/ ]"))


def affiliation_values(records: DataFrame, fields: tuple[str, ...] = ("utb_wos_affiliation", "utb_scopus_affiliation"), row_id: str = "resource_id") -> DataFrame:
    """Values of affiliation fields of ``records`` in the form of :func:`split_packed`."""
    entries = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"`{f}`").alias("elements")) for f in fields])
    rows = records.select(F.col(f"`{row_id}`").alias("row_id"), F.inline(entries)).filter(F.size("elements") > 0)
    return split_packed(rows.withColumn("dialect", F.lit("affiliation")), {"affiliation": AFFILIATIONS})


def buffer_values(events: DataFrame) -> DataFrame:
    """Values of ``new_value`` of change-buffer events; an event delivered twice counts once.

    Should copies of one event differ, the smallest ``(field_key, new_value)`` is taken.
    """
    several = events.filter(F.col("field_key").isin(*BUFFER_DIALECTS) & (F.trim("new_value") != ""))
    once = several.groupBy(F.col("id").alias("row_id")).agg(F.min(F.struct("field_key", "new_value")).alias("e"))
    texts = once.select(F.lit("new_value").alias("field_name"), "row_id", F.col("e.field_key").alias("dialect"), F.array("e.new_value").alias("elements"))
    return split_packed(texts.filter(_may_hold_several(F.col("elements"))), BUFFER_DIALECTS)


def p3_found(records: DataFrame, events: DataFrame) -> DataFrame:
    """All values of the fields in which some one text holds two or more values."""
    every = affiliation_values(records).unionByName(buffer_values(events))
    return every.filter("packed").drop("packed")
