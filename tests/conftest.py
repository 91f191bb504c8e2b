"""One session for all tests."""

from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


RECORD = {
    "resource_id": "bigint", "dc_title": "array<string>", "dc_contributor_author": "array<string>", "dc_description_abstract": "array<string>", "dc_identifier_doi": "array<string>",
    "dc_identifier_issn": "array<string>", "dc_identifier_isbn": "array<string>", "dc_type": "array<string>", "dc_date_issued": "array<string>", "dc_date_accessioned": "array<string>",
    "dc_publisher": "array<string>", "dc_relation_ispartof": "array<string>", "dc_citation_spage": "array<string>", "dc_citation_epage": "array<string>",
    "utb_contributor_internalauthor": "array<string>", "utb_faculty": "array<string>", "utb_ou": "array<string>", "utb_source": "array<string>", "utb_identifier_wok": "array<string>",
    "utb_identifier_scopus": "array<string>", "utb_identifier_obdid": "array<string>", "utb_wos_affiliation": "array<string>", "utb_scopus_affiliation": "array<string>",
    "utb_fulltext_affiliation": "array<string>", "utb_fulltext_dates": "array<string>", "utb_relation_volume": "string", "utb_relation_issue": "string", "author_flags": "string", "withdrawn": "boolean",
}


@pytest.fixture(scope="session")
def records(spark):
    """Records from dictionaries; fields that aren't given are null, scalars of array fields become one element."""

    def make(*rows: dict):
        ddl = ", ".join(f"{k} {t}" for k, t in RECORD.items())
        listed = lambda k, v: [v] if RECORD[k].startswith("array") and isinstance(v, str) else v
        return spark.createDataFrame([tuple(listed(k, r.get(k)) for k in RECORD) for r in rows], ddl)

    return make
