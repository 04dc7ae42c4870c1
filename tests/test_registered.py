"""Every registered query against its SQL, and the driver's entry points."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry_points
from compare import connect, difference
from workload import oracle
from workload import queries as registered

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def database():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert registered.queries().keys() == oracle.oracle_sql().keys()
    assert registered.queries().keys() <= entry_points.queries().keys()


@pytest.mark.parametrize("name", sorted(registered.queries()))
def test_query(spark, database, name):
    df = entry_points.queries()[name](spark, SF_DIR)
    assert difference(df, database, entry_points.oracle_sql()[name]) is None
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan and "Python" not in plan


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
