"""Turns of conversations in order, without gathering a conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions


def kept(df: DataFrame, folder: str, name: str) -> DataFrame:
    """``df`` as a table in the shared folder."""
    df.write.parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def turn_key(role: Column, text: Column) -> Column:
    """32 bytes that only equal pairs of role and text share."""
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))


def ranked(rows: DataFrame, folder: str, name: str = "ranked") -> DataFrame:
    """``rows`` (conv_id, turn, key, ...) with their rank in the order of (conv_id, turn with nulls first, key).

    Rows are dealt by ranges of all three, so that a conversation with very many turns lies in several tasks. A rank is
    the place in its part plus the sizes of the parts before, a table of one row for each part.
    """
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("key").asc_nulls_first()]
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    placed = kept(dealt.withColumn("at_", F.monotonically_increasing_id()), folder, name)
    part = F.shiftright("at_", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("size")).select("part", F.coalesce(F.sum("size").over(before), F.lit(0).cast("long")).alias("before"))
    rank = F.col("at_").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("before")
    return placed.join(F.broadcast(parts), part == F.col("part")).select(*rows.columns, rank.alias("rank"))


def crc32(text: Column) -> Column:
    return F.crc32(text.cast("binary"))


#: CRC-32 as SQL: ``CRC_TABLE`` is a common table expression named crc_table, ``crc_sql`` the value of an ASCII string where crc_table is joined.
CRC_TABLE = """crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) r(i)))"""


def crc_sql(text: str) -> str:
    codes = f"list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: xor(c // 256, crc_table.t[(xor(c, b) % 256) + 1])), 4294967295)"
