"""Seeded synthetic tables. All rows come from ``spark.range`` and hash-free
``rand(seed)`` columns, so any size is made in parallel and repeats exactly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _pick(seed: int, low: int, high: int) -> Column:
    """Uniform integer in [low, high]."""
    return (F.floor(F.rand(seed) * F.lit(high - low + 1)) + F.lit(low)).cast("int")


def _word(prefix: str, seed: int, n: int) -> Column:
    return F.concat(F.lit(prefix), _pick(seed, 0, n - 1).cast("string"))


def visits(spark: SparkSession, n_urls: int, n_days: int, last_day: str = "2012-12-31", seed: int = 1) -> DataFrame:
    """``(url, date, visits)``; each url goes back one day per row."""
    rows = spark.range(n_urls * n_days)
    back = (F.col("id") % F.lit(n_days)).cast("int")
    return rows.select(
        F.concat(F.lit("url"), F.floor(F.col("id") / F.lit(n_days)).cast("string")).alias("url"),
        F.date_sub(F.lit(last_day).cast("date"), back).alias("date"),
        _pick(seed, 0, 9999).alias("visits"),
    )


def payments(spark: SparkSession, n_departments: int, n_people: int, n_dates: int, n_rows: int = 1, seed: int = 1) -> DataFrame:
    """``(dep, person, date, amount)`` with nested counts."""
    i = F.col("id")
    per_person, per_dep = n_dates * n_rows, n_people * n_dates * n_rows
    return spark.range(n_departments * per_dep).select(
        F.floor(i / F.lit(per_dep)).cast("int").alias("dep"),
        F.concat(F.lit("person"), F.floor(i / F.lit(per_person)) % F.lit(n_people)).alias("person"),
        F.date_add(F.lit("2012-01-01").cast("date"), (F.floor(i / F.lit(n_rows)) % F.lit(n_dates)).cast("int")).alias("date"),
        F.round(F.rand(seed) * 1000, 2).alias("amount"),
    )


def int_pairs(spark: SparkSession, n: int, largest: int, seed: int = 1) -> DataFrame:
    return spark.range(n).select(_pick(seed, 1, largest).alias("first"), _pick(seed + 1, 1, largest).alias("second"))


def topic_texts(spark: SparkSession, n: int, n_topics: int, n_words: int, words_per_text: int = 10, seed: int = 1) -> DataFrame:
    """One JSON document ``{topicId, text}`` per row."""
    text = F.concat_ws(" ", *[_word("w", seed + 1 + k, n_words) for k in range(words_per_text)])
    doc = F.struct(_pick(seed, 0, n_topics - 1).alias("topicId"), text.alias("text"))
    return spark.range(n).select(F.to_json(doc).alias("value"))


def tweets(spark: SparkSession, n: int, n_places: int, n_tags: int, n_days: int = 30, seed: int = 1) -> DataFrame:
    """One JSON tweet per row with place, time and one hashtag."""
    when = F.date_add(F.lit("2012-01-01").cast("date"), _pick(seed, 0, n_days - 1)).cast("timestamp")
    doc = F.struct(
        F.concat(F.lit("Sun "), F.date_format(when, "MMM dd HH:mm:ss Z yyyy")).alias("created_at"),
        F.struct(_word("place", seed + 1, n_places).alias("location")).alias("user"),
        F.struct(F.array(F.struct(_word("tag", seed + 2, n_tags).alias("text"))).alias("hashtags")).alias("entities"),
    )
    return spark.range(n).select(F.to_json(doc).alias("value"))


def url_data(spark: SparkSession, n_hits: int, n_urls: int, n_canonical: int, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """``(nonCanonicalUrl, canonicalUrl)`` and ``(url, timestamp, ip)``."""
    number = F.col("id").cast("string")
    mapping = spark.range(n_urls).select(
        F.concat(F.lit("u"), number).alias("nonCanonicalUrl"), _word("canonical", seed, n_canonical).alias("canonicalUrl")
    )
    hits = spark.range(n_hits).select(
        _word("u", seed + 1, n_urls).alias("url"),
        (F.lit(1325376000) + F.col("id")).alias("timestamp"),
        F.concat_ws(".", *[_pick(seed + 2 + k, 0, 255).cast("string") for k in range(4)]).alias("ip"),
    )
    return mapping, hits


def activity(spark: SparkSession, n: int, n_users: int, n_features: int, max_clicks: int = 100, seed: int = 1) -> DataFrame:
    return spark.range(n).select(
        _word("user", seed, n_users).alias("user"),
        _word("feature", seed + 1, n_features).alias("feature"),
        _pick(seed + 2, 1, max_clicks).alias("clicks"),
    )
