"""Ranks over a whole table without a task that holds it: ranges of values, and the sizes of the ranges before."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def at_or_below(df: DataFrame, value: str) -> DataFrame:
    """(value, n, below, total) of each distinct value: its rows, the rows at or below it, and all rows.

    Equal values are counted before they are dealt by ranges; the ranges' sizes are a table of one row for each range.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = df.groupBy(value).agg(F.count("*").alias("n")).repartitionByRange(n, value).withColumn("_part", F.spark_partition_id())
    counted = cut(ranges)
    sizes = counted.groupBy("_part").agg(F.sum("n").alias("_size"))
    order = Window.orderBy("_part")
    sizes = sizes.select("_part", (F.sum("_size").over(order) - F.col("_size")).alias("_before"), F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    within = F.sum("n").over(Window.partitionBy("_part").orderBy(value))
    return counted.withColumn("_within", within).join(F.broadcast(sizes), "_part").select(value, "n", (F.col("_within") + F.col("_before")).alias("below"), "total")
