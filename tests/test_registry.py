"""Every registered query against its SQL on the smallest given tables."""

import os
import pathlib
import sys

import duckdb
import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry  # noqa: E402
from tools.check_oracle import DATES, TABLES, compare, type_problem  # noqa: E402

FOLDER = os.environ.get("LOOMSTAT_TABLES", "/root/testdata/sf0.001")
QUERIES, SQL = entry.all_queries(), entry.all_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables not present")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, db, name):
    df = QUERIES[name](spark, FOLDER)
    answer = db.sql(SQL[name])
    types = dict(zip(answer.columns, map(str, answer.types)))
    DATES.clear()
    DATES.update(c for c, t in types.items() if t == "DATE")
    assert (compare(df.toPandas(), answer.df()) or type_problem(dict(df.dtypes), types)) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["lang", "word", "count"] and df.count() > 0
