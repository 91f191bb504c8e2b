"""Several values packed into one field."""

from __future__ import annotations

import pytest
from hypothesis import given, settings, strategies as st

from scriptorium.functions.packed import AFFILIATIONS, IDENTIFIERS, NAMES, UNITS, split_values
from scriptorium.operators import packed


@pytest.mark.parametrize(
    ("text", "dialect", "values"),
    [
        ("[A, B; C, D] Univ X, Town 1; [E, F] Univ Y, Town 2; ", AFFILIATIONS, ["[A, B; C, D] Univ X, Town 1", "[E, F] Univ Y, Town 2"]),
        ('"[A, B] Univ X; Sect B, Town"\t[C, D] Univ Y', AFFILIATIONS, ["[A, B] Univ X; Sect B, Town", "[C, D] Univ Y"]),
        ('"Novak J., Centre ""Lesina"", Town"||Dvorak K., Univ', AFFILIATIONS, ['Novak J., Centre "Lesina", Town', "Dvorak K., Univ"]),
        ("Novák, Jan|Dvořák, Petr;Zdižel, Ondřej", NAMES, ["Novák, Jan", "Dvořák, Petr", "Zdižel, Ondřej"]),
        ('"Novák, Jan", "Priya Naen", "Dvořák, P."', NAMES, ["Novák, Jan", "Priya Naen", "Dvořák, P."]),
        ('{"Novák, Jan","Dvořák, P."}', NAMES, ["Novák, Jan", "Dvořák, P."]),
        ("Novák, Jan", NAMES, ["Novák, Jan"]),
        ('"Dept of X, Town; annex", Department of Y', UNITS, ["Dept of X, Town; annex", "Department of Y"]),
        ("Department of X, Town", UNITS, ["Department of X, Town"]),
        ("Department of X, Town||Department of Y", UNITS, ["Department of X, Town", "Department of Y"]),
        ("3855-6503,3356-9436 / 3027-1234 3489-6550", IDENTIFIERS, ["3855-6503", "3356-9436", "3027-1234", "3489-6550"]),
        ('A "quoted" word; B', AFFILIATIONS, ['A "quoted" word', "B"]), ("open [bracket; B", AFFILIATIONS, ["open [bracket", "B"]),
        ("", NAMES, []), (None, NAMES, []), (" ;; | ", AFFILIATIONS, []),
    ],
)
def test_split(text, dialect, values):
    assert split_values(text, dialect) == values


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abc ,;|\n[]", min_size=1, max_size=12), min_size=1, max_size=6))
def test_quoted_values_come_back(values):
    values = [v.strip(" \n\t") for v in values if v.strip(" \n\t")]
    assert split_values(";".join(f'"{v}"' for v in values), AFFILIATIONS) == values


def test_query_and_edge_cases(records, spark):
    df = records(
        {"resource_id": 1, "utb_wos_affiliation": ["[A, B] X; [C, D] Y", "Z"], "utb_scopus_affiliation": ["one"]},
        {"resource_id": 2, "utb_wos_affiliation": [None, ""], "utb_scopus_affiliation": None}, {"resource_id": 3, "utb_scopus_affiliation": ["x" * 60_000 + ";y"]},
    )
    ddl = "id bigint, resource_id bigint, field_key string, new_value string, field_name string"
    events = spark.createDataFrame([(7, 1, "utb.ou", "Dept of A|Dept of B", "clash"), (7, 1, "utb.ou", "Dept of A|Dept of B", "clash"), (8, 1, "dc.title", "a; b", ""), (9, 1, "dc.identifier.issn", None, "")], ddl)
    got = sorted(tuple(r) for r in packed.p3_found(df, events).collect())
    assert [(f, r, p) for f, r, p, _ in got] == [("new_value", 7, 1), ("new_value", 7, 2), ("utb_scopus_affiliation", 3, 1), ("utb_scopus_affiliation", 3, 2), ("utb_wos_affiliation", 1, 1), ("utb_wos_affiliation", 1, 2), ("utb_wos_affiliation", 1, 3)]
    assert packed.p3_found(df.limit(0), events.limit(0)).count() == 0
