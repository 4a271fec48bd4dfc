"""Exact top-k by inner product: columnar branch-and-bound over dimension blocks.

Vectors become integers, floor(scale * x). A block of candidates is stored by
dimension. Scores grow dimension block by dimension block; what the remaining
dimensions can still add is at most the product of the remaining lengths
(Cauchy-Schwarz), and candidates that cannot reach a query's k-th score any
more are dropped from its list before the next block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstat.session import materialise

CANDIDATE_ROWS, QUERY_ROWS = 8_192, 2_048
DIMENSIONS = 16
_AT_ONCE = 256
_LONG = np.iinfo(np.int64)


def _length() -> Column:
    """The Euclidean length of the vector ``v``."""
    return F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of an array of lists as numbers, padded with zeros to ``width``."""
    lengths = np.asarray(vectors.value_lengths())
    values = np.asarray(vectors.flatten())
    if len(lengths) and (lengths == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = values
    return out


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids, in that order."""
    if len(scores) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= floor)
        return keep[np.lexsort((ids[keep], -scores[keep]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def search_block(
    queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int, floors: np.ndarray | None = None
) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query (row ids, scores) of its k best rows other than its own, those that reach its floor."""
    floors = np.full(len(queries), -np.inf) if floors is None else floors
    size = max(float(np.abs(queries).max(initial=0)), float(np.abs(rows).max(initial=0)))
    if size * size * max(queries.shape[1], 1) >= 2.0**53:  # beyond exact doubles: whole numbers of any size
        out = []
        for q, own in zip(queries, query_ids):
            scores = rows.astype(object) @ q.astype(object)
            order = sorted((-s, i) for s, i in zip(scores, row_ids) if i != own)[:k]
            out.append((np.array([i for _, i in order], np.int64), np.array([min(max(-s, _LONG.min), _LONG.max) for s, _ in order], np.int64)))
        return out
    order = np.argsort(-(rows.astype(float) ** 2).sum(axis=0), kind="stable")
    columns = np.ascontiguousarray(rows.T[order].astype(float))
    queries = queries[:, order].astype(float)
    cuts = list(range(0, columns.shape[0], DIMENSIONS)) + [columns.shape[0]]
    left_rows = [np.sqrt((columns[b:] ** 2).sum(axis=0)) for b in cuts]
    left_queries = [np.sqrt((queries[:, b:] ** 2).sum(axis=1)) for b in cuts]
    first = np.argsort(-left_rows[0], kind="stable")[: 4 * k + 1]
    out = []
    for at in range(0, len(queries), _AT_ONCE):
        q, own = queries[at : at + _AT_ONCE], query_ids[at : at + _AT_ONCE]
        seed = np.where(row_ids[first][None, :] == own[:, None], -np.inf, q @ columns[:, first])
        floor = np.sort(seed, axis=1)[:, -k] if seed.shape[1] >= k else np.full(len(q), -np.inf)
        floor = np.maximum(floor, floors[at : at + _AT_ONCE])
        partial = q[:, : cuts[1]] @ columns[: cuts[1]] if len(cuts) > 1 else np.zeros((len(q), columns.shape[1]))
        for i in range(len(q)):
            low, rest = floor[i], left_queries[min(1, len(cuts) - 1)][at + i] * left_rows[min(1, len(cuts) - 1)]
            alive = np.flatnonzero((partial[i] + rest * (1 + 1e-9) + 1e-6 >= low) & (row_ids != own[i]))
            scores = partial[i, alive]
            for b in range(1, len(cuts) - 1):
                scores = scores + q[i, cuts[b] : cuts[b + 1]] @ columns[cuts[b] : cuts[b + 1], alive]
                rest = left_queries[b + 1][at + i] * left_rows[b + 1][alive] * (1 + 1e-9) + 1e-6
                if len(scores) > k:
                    sure = scores - rest
                    low = max(low, np.partition(sure, len(sure) - k)[len(sure) - k])
                keep = scores + rest >= low
                alive, scores = alive[keep], scores[keep]
            best = _best(scores, row_ids[alive], k)
            out.append((row_ids[alive[best]], np.rint(scores[best]).astype(np.int64)))
    return out


def usable(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v) of the rows that take part, as whole numbers."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    numbers = F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    rows = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(True)))
    return rows.select(F.col(id_col).cast("long").alias("id"), numbers.alias("v"))


def top_k(vectors: DataFrame, asked: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score for every row where ``asked`` holds, against all rows.

    A null vector, or one with null or non-finite components, takes no part, and
    neither does a null id. Rows with the query's id are not its candidates; rows
    that share another id are each a candidate. Vectors of different length
    count as padded with zeros; scores beyond 64 bits are cut to them. Fewer
    candidates than ``k`` give fewer rows; other columns are ignored.

    Candidates and queries are dealt by hash into blocks of bounded size, and each
    pair of blocks is one group, so no task holds more than two blocks. Each block of
    queries first meets one block of candidates; the k-th score found there is the
    query's floor, which travels with it to all other blocks: a block whose longest
    row cannot reach it is skipped, and only rows that reach it leave a group.
    """
    rows = usable(vectors.where(F.col(id_col).isNotNull()), id_col, vector_col, scale).withColumn("length", _length())
    queries = usable(vectors.where(asked), id_col, vector_col, scale).withColumn("length", _length())
    n, m = rows.count(), queries.count()
    many, few = max(1, -(-n // CANDIDATE_ROWS)), max(1, -(-m // QUERY_ROWS))
    block, asked_block = (F.pmod(F.xxhash64("id", "v"), F.lit(b)).cast("int") for b in (many, few))
    queries, rows = queries.withColumn("qb", asked_block), rows.withColumn("cb", block)

    def search(asked: pa.Table, held: pa.Table) -> pa.Table:
        found, ids = [], pa.array([], pa.int64())
        if len(asked) and len(held):
            q, r = (t.column("v").combine_chunks() for t in (asked, held))
            width = max(max(v.value_lengths().to_pylist(), default=0) for v in (q, r))
            ids = asked.column("id").combine_chunks()
            floors = asked.column("floor").fill_null(-np.inf).to_numpy()
            found = search_block(_matrix(q, width), ids.to_numpy(), _matrix(r, width), held.column("id").to_numpy(), k, floors)
        names = np.repeat(ids.to_numpy(), [len(i) for i, _ in found]) if found else np.zeros(0, np.int64)
        near = [np.concatenate([f[j] for f in found]) if found else np.zeros(0, np.int64) for j in (0, 1)]
        return pa.table({"query_id": pa.array(names, pa.int64()), "vec_id": pa.array(near[0], pa.int64()), "score": pa.array(near[1], pa.int64())})

    def searched(left: DataFrame) -> DataFrame:
        """The answers of all (query, candidate block) rows of ``left``."""
        pairs = left.select("qb", "cb").distinct()
        right = rows.select("id", "v", "cb").join(pairs, "cb").select("id", "v", F.col("cb").alias("c"), F.col("qb").alias("q"))
        left = left.select("id", "v", "floor", "qb", "cb")
        return left.groupBy("qb", "cb").cogroup(right.groupBy("q", "c")).applyInArrow(search, "query_id long, vec_id long, score long")

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    home = F.col("qb") % F.lit(many)
    first = materialise(searched(queries.withColumns({"cb": home, "floor": F.lit(None).cast("double")})), "first-block")
    floors = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k)
    floors = floors.select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("floor"))
    # Each query goes to the blocks that may still hold one of its k best.
    longest = rows.groupBy("cb").agg(F.max("length").alias("longest"))
    rest = queries.withColumn("home", home).join(floors, "id", "left")
    rest = rest.withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(many - 1)))).where("cb <> home").join(longest, "cb")
    may = F.col("floor").isNull() | (F.col("length") * F.col("longest") * (1 + 1e-9) + 1 >= F.col("floor"))
    found = first.unionByName(searched(rest.where(may)))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
