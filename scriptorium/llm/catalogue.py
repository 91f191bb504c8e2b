"""Queries over the operators of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scriptorium.llm import canonical, lookalikes, mixing, mojibake, names, oracles, packing, repetition, survivors
from scriptorium.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    """Query name to a function of session and folder."""
    return {
        "p1_found": lambda s, d: names.p1_found(table(s, d, "utb_metadata_arr"), table(s, d, "utb_authors")),
        "p2_found": lambda s, d: survivors.p2_found(table(s, d, "utb_metadata_arr"), table(s, d, "dedup_histoire")),
        "p2_values": lambda s, d: survivors.retained_values(table(s, d, "utb_metadata_arr"), table(s, d, "dedup_histoire")),
        "p4_found": lambda s, d: mojibake.p4_found(table(s, d, "utb_metadata_arr")),
        "p5_found": lambda s, d: lookalikes.p5_found(table(s, d, "utb_metadata_arr")),
        "p7_found": lambda s, d: canonical.p7_found(table(s, d, "llm_author_entry"), table(s, d, "utb_metadata_arr"), table(s, d, "canonical_ref")),
        "p8_packing": lambda s, d: packing.pack(table(s, d, "documents"), table(s, d, "pack_capacity")),
        "p8_fill": lambda s, d: packing.fill_report(packing.pack(table(s, d, "documents"), table(s, d, "pack_capacity")), table(s, d, "pack_capacity")),
        "p9_mixture": lambda s, d: mixing.mix(table(s, d, "documents"), table(s, d, "mix_target")),
        "p9_shares": lambda s, d: mixing.share_report(mixing.mix(table(s, d, "documents"), table(s, d, "mix_target")), table(s, d, "mix_target")),
        "p10_retention": lambda s, d: repetition.retention(table(s, d, "documents")),
        "p10_found": lambda s, d: repetition.p10_found(table(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    """Query name to DuckDB SQL."""
    return oracles.sql()
