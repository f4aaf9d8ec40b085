import os

import pytest

from ionfield.plans.catalogue import ORACLE_SQL, QUERIES
from tests.oracle import connect, duck_rows, spark_rows

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, con, name):
    assert spark_rows(QUERIES[name](spark, SF)) == duck_rows(con, ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_gives_rows(spark, name):
    df = QUERIES[name](spark, SF)
    assert len(df.columns) and df.limit(3).count() > 0
