"""Every registered recording query against its SQL on the smallest tables."""

import pytest
from tests.conftest import SMALL
from tests.oracle import duck, same

from neurolake.plans import catalogue


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_matches_sql(spark, con, name):
    same(catalogue.QUERIES[name](spark, SMALL).toPandas(), con.sql(catalogue.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SMALL).count() > 0


def test_entry_points_agree():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
