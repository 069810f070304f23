"""Every core query runs on the smallest tables, and equals its SQL where it has one."""

import pytest
from oracle import DATA, connection, duck_rows, spark_rows

from lexmill.queries import core

SQL = core.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query(spark, con, name):
    df = core.queries()[name](spark, DATA)
    if name not in SQL:
        df.count()
        return
    assert spark_rows(df) == duck_rows(con, SQL[name])


def test_sql_has_no_strangers():
    assert set(SQL) <= set(core.queries())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(core.queries()) <= set(__spark_entry__.queries())
