"""Text documents: JSON lines, whole files, folders, labelled lines, HTML blocks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TWEET = "created_at string, user struct<location:string>, entities struct<hashtags:array<struct<text:string>>>"


def read_json_lines(spark: SparkSession, path, schema: T.StructType | str) -> DataFrame:
    """One JSON document per line under a declared schema (no inference pass)."""
    return spark.read.schema(schema).json(path)


def parse_json(df: DataFrame, column: str, schema: str, keep=()) -> DataFrame:
    """Expand a JSON text column to the declared fields."""
    return df.select(*keep, F.from_json(column, schema).alias("_doc")).select(*keep, "_doc.*")


def hashtags(tweets: DataFrame) -> DataFrame:
    """One row per hashtag with the tweet's place and its unpadded date."""
    from loomstat.functions.text import plain_date, tweet_time

    return tweets.select(
        F.col("user.location").alias("location"),
        plain_date(tweet_time(F.col("created_at"))).alias("date"),
        F.explode("entities.hashtags").alias("tag"),
    ).select("location", "date", F.col("tag.text").alias("hashtag"))


def read_whole_files(spark: SparkSession, path) -> DataFrame:
    """One ``(folder, name, text)`` row per file."""
    files = spark.read.text(path, wholetext=True)
    full = F.input_file_name()
    return files.select(
        F.regexp_extract(full, r"^(.*)/[^/]+$", 1).alias("folder"),
        F.regexp_extract(full, r"([^/]+)$", 1).alias("name"),
        F.col("value").alias("text"),
    )


def read_categories(spark: SparkSession, root: str, depth: int = 2) -> DataFrame:
    """Lines of ``root/<category>/<title>`` with both names as columns.

    With a ``depth`` of 3 a title is a folder of files, ``root/<category>/<title>/<any>``.
    """
    if depth not in (2, 3):
        raise ValueError("depth is 2 or 3")
    path = F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B"))
    lines = spark.read.text("/".join([root.rstrip("/"), *["*"] * depth]))
    place = F.slice(F.split(path, "/"), -depth, 2)
    return lines.select(place[0].alias("category"), place[1].alias("title"), F.col("value").alias("text"))


def labelled_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """``label \\t id \\t text`` → key ``/label/id`` and text; short lines are skipped."""
    parts = F.split(F.col(value), "\t", 3)
    return (
        lines.select(parts.alias("_p"))
        .where(F.size("_p") == 3)
        .select(
            F.concat(F.lit("/"), F.col("_p")[0], F.lit("/"), F.col("_p")[1]).alias("key"),
            F.col("_p")[0].alias("label"),
            F.col("_p")[2].alias("text"),
        )
    )


def extract_blocks(
    pages: DataFrame,
    html: str,
    start: str,
    end: str,
    fields: Mapping[str, str],
    page_id: Column,
    page_name: str = "page_id",
) -> DataFrame:
    """Repeated blocks of a page: text from a ``start`` match to the next ``end``.

    Each field is group 1 of its pattern within the block, trimmed, or null when
    the pattern does not occur.
    """
    block = f"(?s)(?:{start}).*?(?={end})"
    rows = pages.select(
        page_id.alias(page_name), F.posexplode(F.regexp_extract_all(html, F.lit(block), F.lit(0))).alias("block_no", "_block")
    )
    out = [
        F.when(F.col("_block").rlike(pattern), F.trim(F.regexp_extract("_block", pattern, 1))).alias(name)
        for name, pattern in fields.items()
    ]
    return rows.select(page_name, "block_no", *out)


def check_flat(schema: T.StructType) -> None:
    """Only plain text, number and boolean fields can be exported as documents."""
    for f in schema:
        plain = isinstance(f.dataType, (T.NumericType, T.StringType, T.BooleanType))
        if not plain or (f.metadata or {}).get("enum"):
            raise ValueError(f"{f.name}: {f.dataType.simpleString()} cannot go into a flat document")


def flat_documents(df: DataFrame) -> DataFrame:
    """One JSON text per row, after the flatness check."""
    check_flat(df.schema)
    return df.select(F.to_json(F.struct(*df.columns)).alias("document"))


def write_flat_documents(df: DataFrame, path: str, by: str | None = None, mode: str = "error") -> None:
    """JSON-lines export, in one folder per value of ``by`` when given."""
    check_flat(df.schema)
    writer = df.write.mode(mode)
    (writer.partitionBy(by) if by else writer).json(path)
