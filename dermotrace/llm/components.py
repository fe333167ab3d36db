"""Connected components of a distributed edge list by alternating large-star and small-star steps.

Each step is a ``groupBy(node).agg(min)`` (combined before the shuffle) and an equi-join back, which deals the rows of a
node with very many neighbours to several tasks. Every round is cut by a reliable checkpoint. Nothing but two sums a
round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, spread_join


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") > F.col("u")).alias("_n")).select("u", F.least("u", "m").alias("m"), "_n")
    return spread_join(both.where("v > u"), least, ["u"], ["v"], n).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n"))
    moved = spread_join(down, least, ["u"], ["v"], n).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (u long, v long): root is the smallest node reachable."""
    edges = cut(edges.where("u != v").select("u", "v").distinct())
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or now[0] == 0:
            break
        state = now
        edges = cut(_small_star(_large_star(edges, now[0]), now[0]))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
