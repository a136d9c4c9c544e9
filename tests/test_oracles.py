"""Every core query with SQL agrees with it on the smallest tables; the others run with a stable schema."""

import pytest
from oracle import connect, same

from marlstone.plans import catalogue

QUERIES, ORACLES = catalogue.queries(), catalogue.oracles()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, con, name):
    same(spark, sf, con, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_query_without_sql_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.columns and df.count() >= 0


def test_every_oracle_has_its_query():
    assert ORACLES.keys() <= QUERIES.keys() and len(QUERIES) > 90
