"""Self-describing files, catalog tables, several sinks and series export."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstat.functions.schema import conform

# The types a catalog or sample-based schema may hold.
FLAT_TYPES = (
    T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.BooleanType, T.StringType, T.BinaryType,
)


def read_table_files(spark: SparkSession, path, target: T.StructType | None = None) -> DataFrame:
    """Parquet rows, optionally read as another schema (see ``conform``)."""
    df = spark.read.parquet(path)
    return df if target is None else conform(df, target)


def write_table_files(df: DataFrame, path: str, mode: str = "error", compression: str | None = None) -> None:
    writer = df.write.mode(mode)
    (writer.option("compression", compression) if compression else writer).parquet(path)


def avro_available(spark: SparkSession) -> bool:
    """Whether the external Avro connector is on the classpath."""
    try:
        spark.read.format("avro").schema("a int").load("file:///no-such-file")
    except Exception as error:  # the JVM error class depends on the Spark build
        return "DATA_SOURCE_NOT_FOUND" not in str(error) and "Failed to find" not in str(error) and "EXTERNAL" not in str(error)
    return True


def write_nested(df: DataFrame, path: str, fmt: str = "parquet", compression: str | None = None) -> None:
    """Nested rows as Parquet, or as Avro where the connector is installed."""
    writer = df.write.format(fmt)
    (writer.option("compression", compression) if compression else writer).save(path)


def read_nested(spark: SparkSession, path, fmt: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema else reader).load(path)


def widen_flat(df: DataFrame) -> DataFrame:
    """Byte and short columns become int; anything nested is rejected."""
    out = []
    for f in df.schema:
        kind = f.dataType
        if isinstance(kind, (T.ByteType, T.ShortType)):
            out.append(F.col(f.name).cast("int").alias(f.name))
        elif isinstance(kind, FLAT_TYPES):
            out.append(F.col(f.name))
        else:
            raise ValueError(f"{f.name}: {kind.simpleString()} is not a flat type")
    return df.select(*out)


def read_catalog(spark: SparkSession, table: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A catalog table through the flat type rules."""
    df = spark.table(table)
    return widen_flat(df.select(*columns) if columns else df)


def named_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Give positional columns names and apply the flat type rules."""
    if len(names) != len(df.columns):
        raise ValueError(f"{len(df.columns)} columns but {len(names)} names")
    return widen_flat(df.toDF(*names))


def from_rows(spark: SparkSession, rows, schema: T.StructType | str) -> DataFrame:
    """A small in-memory collection as a DataFrame."""
    return spark.createDataFrame(list(rows), schema)


def gather(inputs: Sequence[tuple[DataFrame, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """Several inputs, each through its own mapping, as one set of rows."""
    if not inputs:
        raise ValueError("at least one input is needed")
    mapped = [prepare(df) for df, prepare in inputs]
    out = mapped[0]
    for df in mapped[1:]:
        out = out.unionByName(df)
    return out


def write_outputs(
    df: DataFrame, outputs: Mapping[str, Callable[[DataFrame], DataFrame]], root: str, fmt: str = "parquet", mode: str = "error"
) -> dict[str, str]:
    """Write several views of one computed DataFrame to ``root/<name>``.

    The input is persisted (memory, then disk) so that it is computed once.
    """
    for name in outputs:
        if not name.isalnum():
            raise ValueError(f"output name {name!r} must be letters and digits")
    paths = {name: f"{root}/{name}" for name in outputs}
    df = df.persist()
    try:
        for name, view in outputs.items():
            view(df).write.mode(mode).format(fmt).save(paths[name])
    finally:
        df.unpersist()
    return paths


def write_by_name(df: DataFrame, name: str, path: str, fmt: str = "parquet", files_per_name: int = 0, mode: str = "error") -> None:
    """One folder per value of ``name``.

    With ``files_per_name`` the rows are first spread by name and a row hash, so
    each name gets at most that many files per shuffle bucket and a name that
    holds most rows is still written by many tasks.
    """
    if files_per_name > 0:
        others = [c for c in df.columns if c != name] or [name]
        spread = F.pmod(F.xxhash64(*others), F.lit(files_per_name))
        df = df.repartition(F.col(name), spread)
    df.write.mode(mode).format(fmt).partitionBy(name).save(path)


def counted(df: DataFrame, counters: Mapping[str, Column], name: str = "counters") -> tuple[DataFrame, Observation]:
    """Count rows per condition while they flow to any sink."""
    seen = Observation(name)
    return df.observe(seen, *[F.count_if(c).alias(k) for k, c in counters.items()]), seen


def wide_series(df: DataFrame, ts: str, metric: str, value: str, metrics: Sequence[str]) -> DataFrame:
    """One row per time, one column per listed metric; NaN is dropped.

    The metric list is explicit, so the pivot needs no extra pass.
    """
    clean = df.where(~F.isnan(value))
    return clean.groupBy(ts).pivot(metric, list(metrics)).agg(F.sum(value))


def json_points(df: DataFrame, ts: str, metric: str, value: str) -> DataFrame:
    """One ``[value, epoch seconds]`` JSON text per data point; NaN is dropped.

    Points stay one per row, so a long series never sits in one record.
    """
    seconds = F.unix_seconds(F.col(ts).cast("timestamp")).cast("string")
    point = F.concat(F.lit("["), F.col(value).cast("string"), F.lit(","), seconds, F.lit("]"))
    return df.where(~F.isnan(value)).select(metric, ts, point.alias("datapoint"))
