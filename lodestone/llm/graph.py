"""Connected components of a distributed edge list by alternating large-star and small-star steps.

Every step is an aggregation with a map-side combine and an equi-join in which the rows of a hub stay where they are, so
that a hub of any degree is spread; each round is written to the shared folder, and no edges come to the driver.  The number of rounds grows with the logarithm
of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, spread_join

MAX_ROUNDS = 60
#: Up to this many edges the smallest neighbours of all nodes are below 8 MB, and are broadcast.
FEW_EDGES = 160_000


def _with_low(edges: DataFrame, low: DataFrame, n_edges: int) -> DataFrame:
    """edges joined with (u, m, n) on u, where n is how often u stands there."""
    if n_edges <= FEW_EDGES:
        return edges.join(F.broadcast(low), "u")
    return spread_join(edges, materialize(low, "edge-lows"), "u", "n")


def _large_star(edges: DataFrame, n_edges: int) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return _with_low(both.where("v > u"), low, n_edges).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, n_edges: int) -> DataFrame:
    """Expects u > v in every edge."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = _with_low(edges, low, n_edges).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (u, v); the component is the smallest node reachable."""
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialize(edges, "edges")
    before = _state(edges)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        edges = _large_star(edges, before[0])
        if before[0] > FEW_EDGES:
            edges = materialize(edges, "edges")
        edges = materialize(_small_star(edges, before[0]), "edges")
        now = _state(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
