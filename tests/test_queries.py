"""Registered queries against their SQL on the smallest tables.

``python -m queries.check`` runs every query at any scale; here the reports that
share one plan are represented by a few.
"""

import os

import pytest

import __spark_entry__ as driver
from queries.catalogue import QUERIES, SQL
from queries.check import compare, database

SMALL = os.environ.get("STAGEWISE_TEST_DIR", "/root/testdata/sf0.001")
SHARED_PLAN = ("flags_", "labels_", "funnel_lead", "funnel_request", "by_", "filtered", "conversion")
CHOSEN = {"flags_month", "flags_exact_day", "flags_refresh", "labels_refresh", "labels_week", "funnel_request_basis", "by_lead_type", "conversion_as_of"}
NAMES = [n for n in QUERIES if n in CHOSEN or not n.startswith(SHARED_PLAN)]


@pytest.fixture(scope="module")
def db():
    return database(SMALL)


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)
    assert set(QUERIES) <= set(driver.queries())
    assert set(SQL) <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, db, name):
    result = compare(spark, db, SMALL, name)
    assert result.startswith("ok rows="), result


def test_entry_has_rows(spark):
    assert not driver.entry(spark).isEmpty()
