"""Where registered queries and their SQL equivalents are kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.session import materialise, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with the SQL that must give the same rows if there is one."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql.strip()
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# ---- shared shapes over the given tables, each with its SQL twin -------------------


def metric_table(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` as (host, metric, ts, value, units)."""
    e = table(spark, folder, "events")
    rack = F.floor(F.col("user_id") / F.lit(20)).cast("string")
    rank = (F.col("user_id") % F.lit(20)).cast("string")
    return e.select(
        F.concat(F.lit("compute-"), rack, F.lit("-"), rank).alias("host"),
        F.col("event_type").alias("metric"),
        "ts",
        "value",
        F.lit("u").alias("units"),
    )


METRICS = """
m AS (SELECT 'compute-' || CAST(user_id // 20 AS VARCHAR) || '-' || CAST(user_id % 20 AS VARCHAR) AS host,
             event_type AS metric, ts, value, 'u' AS units FROM events),
a AS (SELECT max(ts) AS as_of FROM m),
l AS (SELECT host, metric, value, units, ts FROM (
        SELECT *, row_number() OVER (PARTITION BY host, metric ORDER BY ts DESC, value DESC) AS rn FROM m) WHERE rn = 1),
s AS (SELECT host, max(ts) AS last_ts FROM m GROUP BY host)
"""
AGE = "(CAST(floor(epoch(as_of)) AS BIGINT) - CAST(floor(epoch({0})) AS BIGINT))"


def as_of(metrics: DataFrame) -> Column:
    return metrics.agg(F.max("ts").alias("t")).scalar()


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """``documents``, spread over the cores when it comes in too few splits."""
    return spread(table(spark, folder, "documents"), "doc_id")


def token_rows(spark: SparkSession, folder: str) -> DataFrame:
    """``documents`` as one row per blank-separated word."""
    from loomstat.functions.text import tokens

    d = documents(spark, folder)
    return d.select("doc_id", "lang", "source", F.explode(tokens(F.col("text"))).alias("word"))


TOKENS = r"""
tok AS (SELECT doc_id, lang, source, word FROM (
          SELECT doc_id, lang, source, unnest(string_split_regex(text, '[ \t\n\r\f]+')) AS word FROM documents)
        WHERE word <> '')
"""


def year_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Word counts per "year"; the document source stands in for the year."""
    rows = token_rows(spark, folder).select("word", F.col("source").alias("year"))
    return rows.groupBy("word", "year").agg(F.count("*").alias("count"))


def year_table(spark: SparkSession, folder: str) -> DataFrame:
    """``year_counts`` as a model table, written once for plans that use it often."""
    return materialise(year_counts(spark, folder), "year-counts")


COUNTS = TOKENS + ", counts AS (SELECT word, source AS year, count(*) AS count FROM tok GROUP BY ALL)"


def phrases(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def ratings(spark: SparkSession, folder: str) -> DataFrame:
    """Customers rate suppliers: the largest quantity they ordered from each."""
    o, li = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    return (
        li.join(o, li.l_orderkey == o.o_orderkey)
        .groupBy(F.col("o_custkey").alias("user"), F.col("l_suppkey").alias("item"))
        .agg(F.max("l_quantity").alias("rating"))
    )


def ratings_table(spark: SparkSession, folder: str) -> DataFrame:
    """``ratings`` written once, for the recommenders read them several times."""
    return materialise(ratings(spark, folder), "ratings")


RATINGS = """
r AS (SELECT o_custkey AS u, l_suppkey AS i, max(l_quantity) AS x
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)
"""
