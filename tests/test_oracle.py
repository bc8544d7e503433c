"""Every registered query against its SQL, all rows and values."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
import oracle

UNWANTED = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "InPandas")
QUERIES, SQL = contract.QUERIES, contract.ORACLES


@pytest.fixture(scope="module")
def db(sf_dir):
    return oracle.connect(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", QUERIES)
def test_matches_sql(name, spark, sf_dir, db):
    result = QUERIES[name](spark, sf_dir)
    found = oracle.spark_rows(result)
    assert found[1], "no rows"
    assert oracle.difference(found, oracle.sql_rows(db, SQL[name])) is None
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert [word for word in UNWANTED if word in plan] == []


def test_entry(spark):
    result = contract.entry(spark)
    assert result.columns == ["trip_date", "trips", "revenue"]
    assert result.count() > 0
