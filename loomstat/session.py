"""Session settings and the shared folder used for checkpoints and round trips."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "loomstat", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution and skew joins on.

    No shuffle partition count is fixed here: a cluster sets its own, and AQE
    coalesces small partitions. Pass ``master`` only for local runs.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    A session without the setting is an error, because a machine-local folder
    would be lost with its executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    For tables that several branches of a plan use: later reads are columnar
    and pruned, and losing an executor costs no recomputation. Runs one job.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-spread an input that comes in fewer splits than there are cores.

    A large table has more splits than the cluster has cores and is returned
    untouched; only a small or badly split one is shuffled, before heavy
    per-row work.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)


def text_tasks(df: DataFrame, text: str, size: int = 8 * 2**20) -> int:
    """Tasks that get about ``size`` bytes of text each, whatever the input's splits; one job adds the bytes up."""
    total = df.agg(F.sum(F.octet_length(text)).alias("b")).head()["b"] or 0
    return max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(total / size))


def by_document(df: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, text), dealt by document into tasks of bounded size.

    What is counted per document afterwards needs no shuffle of its own: texts cross
    one, their words do not.
    """
    return df.select(doc, text).repartition(text_tasks(df, text), doc)
