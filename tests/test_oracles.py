"""Every registered query against its SQL, at TEST_SF_DIR."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from platewise.plans.catalog import QUERIES
from platewise.plans.oracles import ORACLES
from tests.compare import differences, duck


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(queries()) and set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, sf_dir, con, name):
    assert differences(QUERIES[name](spark, sf_dir), con, ORACLES[name]) == []


def test_entry(spark):
    assert entry(spark).count() == 8
