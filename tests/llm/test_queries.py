"""Every query of the training-data operators that has SQL, against DuckDB."""

from __future__ import annotations

import oracle
import pytest

from tripstrata.llm.catalogue import ORACLES, QUERIES


@pytest.fixture(scope="module")
def db(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(name, spark, sf_dir, db):
    found = oracle.spark_rows(QUERIES[name](spark, sf_dir))
    assert found[1], "no rows"
    assert oracle.difference(found, oracle.sql_rows(db, ORACLES[name])) is None
