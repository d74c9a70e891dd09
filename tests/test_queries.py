"""Every ready-made query runs, and gives the rows of its SQL."""

import pytest

from tests.compare import database, spark_rows, sql_rows
from tidewater import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, con, name):
    names, rows = spark_rows(plans.QUERIES[name](spark, SF))
    if name in plans.SQL:
        assert (names, rows) == sql_rows(con, plans.SQL[name])


def test_every_sql_has_a_query():
    assert set(plans.SQL) <= set(plans.QUERIES)
