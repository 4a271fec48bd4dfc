"""The registered queries and the pipeline on the smallest given tables."""

import os
import zlib

import duckdb
import pytest

import corpus_pipeline
from loomstat.llm import queries
from tests.test_registry import FOLDER
from tools.check_oracle import TABLES, compare

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables not present")
SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    assert compare(queries.queries()[name](spark, FOLDER).toPandas(), db.execute(SQL[name]).df()) is None


def test_held_out_labels(spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").toPandas().set_index("doc_id")
    got = queries.op5_quality(spark, FOLDER).toPandas().set_index("doc_id").join(labels, how="inner")
    assert (got.predicted == got.quality)[got.held_out].mean() > 0.9
    assert all(bool(h) == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in got.held_out.items())


def test_stages_take_effect(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact_dedup", "near_dedup", "pii", "packing"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:2]:
        after = stage(spark, docs, FOLDER).cache()
        assert after.columns == docs.columns and 0 < after.count() <= docs.count()
        docs = after
    assert docs.select("text").distinct().count() == docs.count()
    near = corpus_pipeline.drop_near_copies(spark, docs, FOLDER)
    assert near.columns == docs.columns and near.count() <= docs.count()
    clean = corpus_pipeline.redact_personal_data(spark, near, FOLDER)
    assert clean.columns == docs.columns and clean.count() == near.count()
    packed = corpus_pipeline.pack_sequences(spark, clean, FOLDER)
    assert packed.select("doc_id").distinct().count() == clean.count()


def test_stages_with_repeated_and_null_ids(spark):
    text = [" ".join(f"{c}{i}" for i in range(60)) for c in "abc"]
    rows = [(1, text[0]), (5, text[0] + " end"), (5, text[1]), (5, text[1]), (7, text[0]), (None, text[2]), (None, text[2]), (None, text[0]), (8, None), (9, "")]
    table = spark.createDataFrame([(i, t, None, "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    once = corpus_pipeline.drop_copies(spark, table, FOLDER).collect()
    assert sorted(((r.doc_id, r.text) for r in once), key=repr) == sorted(
        [(7, text[0]), (5, text[0] + " end"), (5, text[1]), (None, text[2]), (9, "")], key=repr
    )
    near = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(once, table.schema), FOLDER).collect()
    assert sorted(((r.doc_id, r.text) for r in near), key=repr) == sorted(
        [(5, text[0] + " end"), (5, text[1]), (None, text[2]), (9, "")], key=repr
    )
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, table, FOLDER).collect()
        assert stage(spark, table.limit(0), FOLDER).count() == 0
