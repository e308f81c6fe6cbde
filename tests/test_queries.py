"""Every query of the core runs and gives the rows of its SQL, over whole tables."""

import pytest

from docmill.plans import registry
from tests.compare import assert_same, database

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    return database(data)


def test_names():
    assert set(SQL) <= set(QUERIES)
    assert registry.FLAGSHIP in QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, con, name):
    df = QUERIES[name](spark, data)
    if name in SQL:
        assert_same(df, con, SQL[name])
    else:
        assert df.columns and df.count() >= 0


def test_entry(spark, data):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_partitions_do_not_matter(spark, data):
    rows = []
    for n in (1, 8):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        rows.append(sorted(map(str, QUERIES["evidence"](spark, data).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert rows[0] == rows[1]
