import pytest
from oracle import DATA, connection, duck_rows, spark_rows

from lexmill.llm import queries as llm

SQL = llm.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_query(spark, con, name):
    df = llm.queries()[name](spark, DATA)
    if name not in SQL:
        df.count()
        return
    assert spark_rows(df) == duck_rows(con, SQL[name])
