"""Every registered query of the library against its SQL, on the smallest tables."""

import pytest
from compare import connect, rows_of_spark, rows_of_sql

from wayfold import plans

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, con, name):
    df = plans.QUERIES[name](spark, FOLDER)
    assert df.columns
    cols, rows = rows_of_spark(df)
    if name in plans.ORACLES:
        want_cols, want = rows_of_sql(con, plans.ORACLES[name])
        assert cols == want_cols
        assert rows == want
    else:
        assert rows


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 11
    assert set(e.oracle_sql()) <= set(e.queries())
