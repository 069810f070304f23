"""Streams over a table that is a folder of files, in more than one micro-batch, equal their SQL."""

import os

import duckdb
import pytest
from oracle import DATA, duck_rows, spark_rows

from lexmill.queries import core

SQL = core.oracle_sql()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("folders")
    os.mkdir(at / "passages.parquet")
    for i in range(18):
        duckdb.sql(f"COPY (SELECT * FROM '{DATA}/passages.parquet' WHERE row_id % 18 = {17 - i}) TO '{at}/passages.parquet/part-{i:05}.parquet'")
    return at


def same_as_sql(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW passages AS SELECT * FROM '{folder}/passages.parquet/*.parquet'")
    assert spark_rows(core.queries()[name](spark, str(folder))) == duck_rows(con, SQL[name])


def test_windows_of_a_folder(spark, folder):
    same_as_sql(spark, folder, "stream_windows")


def test_word_counts_of_a_folder(spark, folder):
    same_as_sql(spark, folder, "stream_word_counts")
