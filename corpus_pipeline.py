"""From raw documents to packed sequences: filter, deduplicate, redact, pack.

Each stage takes (spark, docs, sf_dir). ``run`` writes every stage's rows to the
shared folder and reads them again as the next stage's documents. All stages but
the last return the columns of ``documents``. Model inputs are the documents of
the stage and the labels beside the tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.llm import exact_dedup, near_dedup, packing, pii, quality
from loomstat.llm.queries import VOCABULARY, quality_model
from loomstat.session import materialise

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    scored = quality.score(docs, quality_model(spark, docs, sf_dir))
    return scored.where("predicted = 1").select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with the same text, the one with the largest id."""
    return exact_dedup.without_copies(docs.select(*COLUMNS))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links join, the one with the smallest id. An id on several rows leaves only if all of them do."""
    return near_dedup.without_near_copies(docs.select(*COLUMNS))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars counts the new text."""
    clean = pii.redact(pii.find_pii(docs.select(*COLUMNS)))
    changed = F.size("pii") > 0
    return clean.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every token piece of every document lies in the packed sequences."""
    return packing.pack(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("quality", filter_quality),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]

#: The learned filter and the tokenizer have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
