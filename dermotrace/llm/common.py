"""Helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import os
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cut, shared_dir  # noqa: F401  cut is used by the operators


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table; any others are pruned, so their names can't clash. Workers import from the repository's root."""
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, [known])])
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


#: Plan nodes whose rows come in the same order every time they are read, a lost executor or not.
_REPLAYED = {"Project", "Filter", "LogicalRelation", "LocalRelation", "LogicalRDD", "SubqueryAlias"}


def _replayed(node) -> bool:
    children = node.children()
    return node.nodeName().split(" ")[0] in _REPLAYED and all(_replayed(children.apply(i)) for i in range(children.size()))


def numbered(df: DataFrame, name: str = "rid") -> DataFrame:
    """``df`` with a number of each row that every evaluation repeats: rows that come out of a shuffle are written first."""
    if not _replayed(df._jdf.queryExecution().optimizedPlan()):
        path = scratch(df.sparkSession, "rows")
        df.write.parquet(path)
        df = df.sparkSession.read.schema(df.schema).parquet(path)
    return df.select(F.monotonically_increasing_id().alias(name), *df.columns)


#: A key with more rows than this is hot, or with more than a share of all rows, so that there are few hot keys.
HOT_ROWS, HOT_KEYS = 250, 20_000


def spread_join(many: DataFrame, one: DataFrame, keys: list[str], by: list[str], rows: int) -> DataFrame:
    """Inner join of ``many`` with ``one``, which has a row for each key and in ``_n`` that key's rows in ``many``.

    The rows of a hot key are dealt by a hash of ``by`` to several places and the key's row is copied to each of them.
    ``rows`` is the size of ``many``: no more than ``HOT_KEYS`` keys can be hot, and only those are broadcast.
    """
    most = max(HOT_ROWS, -(-rows // HOT_KEYS))
    places = F.ceil(F.col("_n") / most).cast("int")
    hot = F.broadcast(one.where(F.col("_n") > most).select(*keys, places.alias("_places")))
    dealt = many.join(hot, keys, "left").withColumn("_place", F.pmod(F.xxhash64(*by), F.coalesce("_places", F.lit(1)).cast("long")).cast("int")).drop("_places")
    copied = one.withColumn("_place", F.explode(F.sequence(F.lit(0), F.greatest(places, F.lit(1)) - 1))).drop("_n")
    return dealt.join(copied, [*keys, "_place"]).drop("_place")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slices(batches, column: str, most: int = 8 << 20):
    """Slices of record batches with about ``most`` bytes of a text column each, one row at least."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            rows = batch.num_rows - at
            while rows > 1 and batch.column(column).slice(at, rows).nbytes > most:
                rows = (rows + 1) // 2
            yield batch.slice(at, rows)
            at += rows


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of finished steps, which wait for a collection on the driver."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
