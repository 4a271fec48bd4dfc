"""Positions and running totals over a global order, without a single-task sort.

A window without partitions would put every row into one task. Here rows are
range-partitioned by the order, numbered inside their partition, and shifted by
the size of the partitions before. Only one number per partition is shared.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstat.session import materialise

_BITS = 33  # monotonically_increasing_id keeps the in-partition position in its low 33 bits


def _placed(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Range-sorted rows with fixed ``_part`` and ``_pos``.

    The written table freezes which row sits where: sampling range boundaries
    anew after a lost executor could otherwise place rows differently in the two
    passes that follow.
    """
    mid = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = ranged.select(
        "*", F.shiftright(mid, _BITS).alias("_part"), mid.bitwiseAND(F.lit((1 << _BITS) - 1)).alias("_pos")
    )
    return materialise(placed, "placed")


def _shifts(per_part: DataFrame) -> DataFrame:
    """Exclusive running sum over the partitions; one row per partition."""
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return per_part.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"))


def with_position(df: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """Add the 0-based position in the global order. Runs one job.

    A row hash breaks ties, so rows with one sort key still spread over tasks.
    """
    placed = _placed(df, [*order, F.xxhash64(*df.columns)])
    sizes = placed.groupBy("_part").agg((F.max("_pos") + 1).alias("_size"))
    # One row per partition of the placed data: the broadcast is that small.
    joined = placed.join(F.broadcast(_shifts(sizes)), "_part")
    return joined.select(*df.columns, (F.col("_pos") + F.col("_shift")).alias(name))


def with_neighbours(df: DataFrame, order: Sequence[Column], key: Column, name: str = "position") -> DataFrame:
    """Add the global position and the ``key`` struct of the rows just before and after.

    Neighbours come from a window inside each range partition; only the two edge
    keys of every partition are shared.
    """
    placed = _placed(df, [*order, F.xxhash64(*df.columns)]).withColumn("_key", key)
    inside = Window.partitionBy("_part").orderBy("_pos")
    local = placed.withColumns({"_before": F.lag("_key").over(inside), "_after": F.lead("_key").over(inside)})
    edges = placed.groupBy("_part").agg(
        F.min_by("_key", "_pos").alias("_first"), F.max_by("_key", "_pos").alias("_last"), (F.max("_pos") + 1).alias("_size")
    )
    # One row per partition from here on.
    parts = Window.orderBy("_part")
    edges = edges.select(
        "_part",
        F.lag("_last").over(parts).alias("_left"),
        F.lead("_first").over(parts).alias("_right"),
        F.coalesce(F.sum("_size").over(parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_shift"),
    )
    joined = local.join(F.broadcast(edges), "_part")
    return joined.select(
        *df.columns,
        "_key",
        (F.col("_pos") + F.col("_shift")).alias(name),
        F.coalesce("_before", "_left").alias("_prev"),
        F.coalesce("_after", "_right").alias("_next"),
    )


def with_running_total(df: DataFrame, order: Sequence[str], value: str, name: str) -> DataFrame:
    """Add the total of ``value`` over all rows before this one in the order."""
    placed = _placed(df, [F.col(c) for c in order])
    sizes = placed.groupBy("_part").agg(F.sum(value).alias("_size"))
    inside = Window.partitionBy("_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("_local", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    joined = local.join(F.broadcast(_shifts(sizes)), "_part")
    return joined.select(*df.columns, (F.col("_local") + F.col("_shift")).alias(name))


def rank_by(df: DataFrame, key: str, name: str = "rank") -> DataFrame:
    """Rank rows by one column: ties share a rank and gaps follow, nulls first.

    Only the distinct keys are sorted globally; rows get their rank by a join.
    """
    counts = df.groupBy(key).agg(F.count("*").alias("_n"))
    ranks = with_running_total(counts, [key], "_n", "_before").select(
        F.col(key).alias("_key"), (F.col("_before") + 1).alias(name)
    )
    return df.join(ranks, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def score_rank(df: DataFrame, score: str, tie: Sequence[str], name: str = "rank") -> DataFrame:
    """Global rank 1..n by descending score, ties by the given columns."""
    order = [F.col(score).desc_nulls_last(), *[F.col(c).asc() for c in tie]]
    placed = with_position(df, order, "_at")
    return placed.select(*df.columns, (F.col("_at") + 1).alias(name))


def position_in_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "position") -> DataFrame:
    """0-based position inside each group, also when one group holds most rows."""
    placed = with_position(df, [*[F.col(k).asc() for k in keys], *order], "_at")
    starts = placed.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.min("_at").alias("_start"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return placed.join(starts, same).select(*df.columns, (F.col("_at") - F.col("_start")).alias(name))


def nearest_rank(df: DataFrame, keys: Sequence[str], value: str, percent: float, name: str = "percentile") -> DataFrame:
    """Exact nearest-rank percentile per group: the value at rank ⌈p/100·n⌉.

    Equal values are counted first and the running count over the global order
    finds the rank, so neither a large group nor a frequent value is gathered.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent must be in (0, 100]")
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    placed = with_running_total(counts, [*keys, value], "_n", "_before")
    groups = placed.groupBy(*keys).agg(F.min("_before").alias("_start"), F.sum("_n").alias("n"))
    # Integer arithmetic: a percent with up to four decimals never rounds wrongly.
    share = F.lit(round(percent * 10_000))
    groups = groups.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        "n",
        (F.col("_start") + F.ceil(F.col("n") * share / F.lit(1_000_000)).cast("bigint")).alias("_want"),
    )
    hit = (F.col("_before") < F.col("_want")) & (F.col("_want") <= F.col("_before") + F.col("_n"))
    for k in keys:
        hit = hit & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return placed.join(groups, hit).select(*keys, "n", F.col(value).alias(name))


def percentile_estimate(df: DataFrame, keys: Sequence[str], value: str, percent: float, name: str = "percentile") -> DataFrame:
    """One-shuffle percentile from bounded per-group summaries."""
    return df.groupBy(*keys).agg(F.approx_percentile(value, percent / 100.0, 10_000).alias(name))
