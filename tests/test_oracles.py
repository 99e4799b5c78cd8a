"""Every registered query with SQL gives the SQL's rows; the others run and keep their schema."""

import pytest

from __spark_entry__ import entry
from cardmill.plans.catalog import oracles, queries
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
# Checked card by card against a written-down loop in test_resolve.py and test_layout.py.
WITHOUT_SQL = {"resolve_people", "resolve_orgs", "graph_summary", "extract_card_fields", "leftover_blocks"}
# No row at this size, and the SQL agrees; at larger sizes they have rows.
EMPTY_HERE = {"page_contacts", "duplicate_page"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_registry():
    assert set(oracles()) <= set(queries()) and set(queries()) - set(oracles()) == WITHOUT_SQL


@pytest.mark.parametrize("name", sorted(oracles()))
def test_query_equals_sql(spark, con, name):
    _, n, same, note = compare(spark, con, name, queries()[name], oracles()[name], SF)
    assert same, note
    assert (n == 0) == (name in EMPTY_HERE)


def test_entry(spark):
    assert entry(spark).count() > 0
