"""Series views of the event table: one track a user, in time order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(track, t seconds, idx tie-break, kind, value)."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    t = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    return df.select(F.col("user_id").alias("track"), t.alias("t"), F.col("event_id").alias("idx"), F.col("event_type").alias("kind"), "value")


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with integer-derived coordinates around one place."""
    lat = F.lit(51.5) + (F.col("idx") * 37 % 1000) * F.lit(1e-5)
    lon = F.lit(-0.1) + (F.col("idx") * 91 % 1000) * F.lit(1e-5)
    return events(spark, sf_dir).withColumns({"lat": lat, "lon": lon})


#: The same views for the oracle.
EVENTS_SQL = """e AS (SELECT user_id AS track, epoch_us(ts) / 1e6 AS t, event_id AS idx, event_type AS kind, value FROM events)"""
POSITIONS_SQL = EVENTS_SQL + """,
p AS (SELECT *, 51.5 + (idx * 37 % 1000) * 1e-5 AS lat, -0.1 + (idx * 91 % 1000) * 1e-5 AS lon FROM e)"""
