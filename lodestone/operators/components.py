"""Connected components of an edge list by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.sources.storage import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    moved = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(joined.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).head()
    return row.n, row.h


def connected_components(edges: DataFrame, left: str = "u", right: str = "v", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge; component is the least node id reachable.

    Each round is two aggregations and joins over the edges; hubs shrink to stars around their
    least neighbour, so the number of rounds grows with the logarithm of the longest path. A hub's
    minimum is pre-aggregated map-side and its edges stream past one row, so a component that
    holds a third of all nodes is no group in memory. Edges with a null end and loops are ignored;
    no edges give no rows. Only a count and a checksum of each round reach the driver.
    """
    current = cut_lineage(
        edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u is not null and v is not null and u != v").distinct()
    )
    before = _state(current)
    if before[0] == 0:
        return current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(max_rounds):
        current = cut_lineage(_small_star(_large_star(current)))
        now = _state(current)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
