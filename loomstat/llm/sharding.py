"""A uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

How many rows of each partition go to each shard is drawn without replacement,
so shards get exactly their size. Every partition deals its rows out in a random
local order, the rows are exchanged, and each shard orders its rows anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstat.session import materialise

#: Rows that are put in order by one task, about.
BLOCK_ROWS = 20_000


#: numpy's sampler takes populations below this.
_NUMPY_LIMIT = 1_000_000_000


def _log_ratio(n: int, p: float, k: int, mode: int) -> float:
    """log of the binomial probability of ``k`` by that of ``mode``: a sum of the exact steps between them."""
    low, high = min(k, mode), max(k, mode)
    j = np.arange(low, high, dtype=float)
    steps = np.log((n - j) / (j + 1)).sum() + (high - low) * np.log(p / (1 - p))
    return float(steps if k > mode else -steps)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int, limit: int = _NUMPY_LIMIT) -> int:
    """How many of ``n`` draws without replacement are good, at any size.

    From ``limit`` on by rejection: the smaller side's number is drawn from a binomial, and kept
    with the probability that the larger side's binomial gives the rest, over its
    largest. Given their sum, two binomials of one p are hypergeometric, so
    the draw is exact; half of the tries or more are kept.
    """
    if not n or not good:
        return 0
    if not bad or n == good + bad:
        return min(n, good)
    if good + bad < limit:
        return int(rng.hypergeometric(good, bad, n))
    small, large = min(good, bad), max(good, bad)
    p = n / (good + bad)
    mode = min(int((large + 1) * p), large)
    while True:
        x = int(rng.binomial(small, p))
        rest = n - x
        if 0 <= rest <= large and np.log(1 - rng.random()) <= _log_ratio(large, p, rest, mode):
            return x if good <= bad else rest


def communication_matrix(rows: list[int], sizes: list[int], seed: int) -> np.ndarray:
    """How many rows each partition sends to each shard: row sums ``rows``, column sums ``sizes``.

    The draw is hypergeometric, partition by partition from the places still free, at any size.
    """
    rng, free, out = np.random.default_rng(seed), np.array(sizes, np.int64), []
    for n in rows:
        drawn = np.zeros(len(free), np.int64)
        left = int(n)
        for s in range(len(free)):
            drawn[s] = hypergeometric(rng, int(free[s]), int(free[s + 1 :].sum()), left)
            left -= int(drawn[s])
        free -= drawn
        out.append(drawn)
    return np.array(out, np.int64).reshape(len(rows), len(sizes))


def shuffle_into_shards(docs: DataFrame, shards: int = 8, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot, grown_shard.

    Law ``rows``: shard sizes differ by one at most, slots count from 0 without a
    gap, and every order is equally likely. ``size`` is the bytes of the text
    plus one; null counts as empty for it. ``grown_shard`` is always null. Equal rows are placed each on
    its own. Other columns are ignored; an empty table gives no rows.

    Texts never leave the reading task. What it keeps of a row, with its partition
    and random local place, is written once, so a task that is repeated deals
    the same. The driver holds one number per partition and shard.
    Within a shard, blocks of about BLOCK_ROWS rows are ordered by many tasks.
    """
    data = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    slim = docs.select(F.col(id_col), F.octet_length(data).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    slim = slim.withColumn("size", F.col("size") + 1)
    schema = T.StructType([*slim.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("place", T.LongType())])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)  # ids and two numbers per row of one input split
        rows, part = sum(map(len, held)), TaskContext.get().partitionId()
        places, at = np.random.default_rng([seed, part]).permutation(rows), 0
        for batch in held:
            own = [pa.array(np.full(len(batch), part, np.int32)), pa.array(places[at : at + len(batch)])]
            at += len(batch)
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], schema.names)

    dealt = materialise(slim.mapInArrow(local, schema), "dealt")
    found = sorted(map(tuple, dealt.groupBy("part").agg(F.count("*").alias("n")).collect()))
    total = sum(n for _, n in found)
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = communication_matrix([n for _, n in found], sizes, seed)
    limits = [(p, [int(x) for x in np.cumsum(m)]) for (p, _), m in zip(found, matrix)]
    limits = docs.sparkSession.createDataFrame(limits, "part int, limits array<long>")

    blocks = max(1, -(-total // (shards * BLOCK_ROWS)))
    placed = dealt.join(limits, "part").withColumn("shard", F.expr("size(filter(limits, x -> x <= place))")).drop("limits")
    order = F.xxhash64("part", "place", F.lit(seed))
    placed = placed.withColumn("_key", order).withColumn("_block", F.pmod(F.xxhash64("_key", F.lit(seed)), F.lit(blocks)).cast("int"))
    counts = placed.groupBy("shard", "_block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("shard", "_block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy("shard", "_block").orderBy("_key", "part", "place")
    ordered = placed.withColumn("_at", F.row_number().over(inside)).join(shifts, ["shard", "_block"])
    return ordered.select(
        id_col,
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("_at") - 1 + F.col("_shift")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
