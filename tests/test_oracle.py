"""Every registered query against its SQL, on the smallest tables."""

import pytest

from __spark_entry__ import entry
from pagestream.plans import expansion
from tests.check import compare, duck
from workload import catalog, oracle

queries, oracle_sql = lambda: catalog.QUERIES, lambda: oracle.ORACLE
SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return duck(SF_DIR)


def test_every_query_has_sql():
    assert set(queries()) == set(oracle_sql())


def test_entry(spark):
    assert entry(spark).count() == 10


@pytest.mark.parametrize("name", list(queries()))
def test_query_equals_sql(spark, connection, name):
    assert compare(queries()[name](spark, SF_DIR), connection, oracle_sql()[name]) is None


def test_sorted_views_row_by_row(spark, connection):
    frame = catalog._sorted(spark, SF_DIR)
    assert compare(frame, connection, oracle.SORTED_VIEWS) is None
