"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstat.llm.common import with_group_values
from loomstat.session import materialise


def _directed(edges: DataFrame) -> DataFrame:
    """Every edge once, from the larger to the smaller node; loops go."""
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()


def _with_least(edges: DataFrame) -> DataFrame:
    """Every edge (u, v) with the least v of its u; a node of very many edges is cut into slices."""
    return with_group_values(edges, ["u"], F.col("v"), {"low": F.min("v")}, {"m": F.min("low")})


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    found = _with_least(edges)
    ways = F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
    return found.select(F.explode(ways).alias("e")).select("e.*")


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 998_244_353)).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); the component is its smallest node.

    Every round halves the depth of what is left, so even a long chain takes a
    logarithmic number of rounds. Each round's edges are written to the shared
    folder, which cuts the lineage; only a count and two checksums reach the
    driver. An empty table gives an empty result.
    """
    now = materialise(_directed(edges), "edges")
    state = _state(now)
    while True:
        now = materialise(_directed(_small_star(_directed(_large_star(now)))), "edges")
        last, state = state, _state(now)
        if state == last:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
