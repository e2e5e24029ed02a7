"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loomcat.session import dropped, settled, stored


def _least(edges: DataFrame) -> DataFrame:
    """u, m: the least of each node and its neighbours."""
    return edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """node, component: the least node of the component of every node that has an edge.

    Each round joins edges with one least neighbour per node, so a node with many neighbours is never gathered in a
    task, and the number of rounds grows with the logarithm of the longest path. Loops and repeated edges do no harm;
    edges with a null end are left out.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    nodes = settled(_both(e).select("u").distinct())
    e = stored(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    for _ in range(rounds):
        two = _both(e)
        large = two.join(_least(two), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, e = e, stored(large.where("u <> v").distinct())
        dropped(before)
        down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small = down.join(down.groupBy("u").agg(F.min("v").alias("m")), "u")
        before, e = e, stored(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        dropped(before)
        mark = e.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components are not complete after {rounds} rounds")
    least = settled(e.groupBy("u").agg(F.min("v").alias("m")))
    dropped(e)
    return nodes.join(least, "u", "left").select(F.col("u").alias("node"), F.coalesce("m", "u").alias("component"))
