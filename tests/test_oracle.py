"""Every query with SQL returns what the SQL returns; every other one runs."""

from __future__ import annotations

import pytest
from compare import connect, spark_rows, sql_rows

from strikeline.plans import load

QUERIES, ORACLE = load()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, con):
    df = QUERIES[name](spark, sf_dir)
    columns, rows = spark_rows(df)
    if name in ORACLE:
        assert (columns, rows) == sql_rows(con, ORACLE[name])
    else:
        assert rows


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
