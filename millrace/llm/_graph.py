"""Connected components over an edge table, without bringing edges to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._stage import settle


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Labels every node of an undirected edge table (``a``, ``b``: long) with its component.

    Returns (node, component) where component is the smallest node reachable.
    Alternates the two star contractions of the map-reduce algorithm for
    components: each round hangs larger neighbours on the smallest one, until
    nothing changes.  A hub of any degree costs one row of two numbers per
    neighbour and round; minima are combined before the shuffle, and the join
    with a hub's one minimum streams (adaptive execution splits it by size).
    Self loops give a node its
    own component; null ends are ignored; no edges give no rows.
    """
    now = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    alone = edges.where("a = b").select(F.col("a").alias("node")).distinct()
    mark = _mark(now)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        now = settle(_small(_large(now)))
        was, mark = mark, _mark(now)
        if mark == was:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    hubs = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    linked = stars.unionByName(hubs)
    rest = alone.join(linked.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
    return settle(linked.unionByName(rest))


def _mark(edges: DataFrame) -> tuple:
    """Row count and an order-free digest, to see when rounds stop changing anything."""
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def _large(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours move to the smallest of its neighbours and itself."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """A node's smaller neighbours, and the node, move to the smallest of them (u > v holds on input)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
