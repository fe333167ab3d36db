"""Operator 6: exact duplicates by deterministic block naming; DataFrame operations only.

Texts are normalised (white space deleted) and only those whose length and 64-bit hash are shared go further: any other
text has no equal. The rest are cut into fixed-size blocks; distinct blocks are sorted (a hash first) and numbered, which gives each
block an integer name, its rank; then adjacent pairs of names are sorted and numbered in turn, until each text has one
name. Equal length and name mean equal texts: the hash only selects, it decides nothing. Names depend on the blocks
alone, not on how they were dealt; a name table is written before it is used, so a task that runs again sees the same.

A group of copies is only met by joins with one row a name, which deal a hot name's rows to several tasks, and by
combining aggregates.

Nulls and empty texts count as empty and are equal. Rows that share a doc_id are rows of their own; of rows that tie in
length and doc_id one stays. A null doc_id loses ties. Very long texts are cut into blocks like any other. An empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import numbered, partitions, read_table, scratch, spread_join

BLOCK = 4096
#: Up to so many shared (length, hash) keys of 16 bytes are broadcast; more are joined by shuffle.
BROADCAST_KEYS = 200_000
#: The characters that are deleted.
SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def normalised(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for c in SPACES:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _kept(df: DataFrame, folder: str, name: str) -> DataFrame:
    df.write.parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def _named(rows: DataFrame, keys: list[str], folder: str, name: str) -> DataFrame:
    """``rows`` with ``name`` in place of the keys: the rank of the distinct keys in the order of (hash, keys).

    The hash leads so that the splitters sampled for the sort are short and even; it decides no equality. A rank is the
    place in its sorted part plus the sizes of the parts before, a table of one row for each part.
    """
    distinct = rows.groupBy(keys).agg(F.count("*").alias("_n")).withColumn("lead", F.xxhash64(*keys))
    ordered = distinct.repartitionByRange(partitions(rows.sparkSession), "lead").sortWithinPartitions("lead", *keys)
    placed = _kept(ordered.select(*keys, "_n", F.monotonically_increasing_id().alias("at_")), folder, f"{name}-names")
    part = F.shiftright("at_", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("size")).select("part", F.coalesce(F.sum("size").over(before), F.lit(0).cast("long")).alias("before"))
    rank = F.col("at_").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("before")
    names = placed.join(F.broadcast(parts), part == F.col("part")).select(*keys, "_n", rank.alias("name"))
    named = spread_join(rows, names, keys, ["rid", "at"], rows.count())
    return _kept(named.select("rid", "n_bytes", "n_blocks", "at", "name"), folder, name)


def _texts(documents: DataFrame) -> DataFrame:
    text = normalised(F.col("text"))
    rows = documents.select("rid", F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.length("text"), F.lit(0)).alias("n_points"), text.alias("plain"))
    return rows.withColumns({"n_bytes": F.octet_length("plain"), "h": F.xxhash64("plain")})


def identities(documents: DataFrame, folder: str, block: int = BLOCK, number: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(every row with its digest, (rid, n_bytes, level, name) of the rows that may have an equal)."""
    documents = documents.select(F.col(number).alias("rid"), "doc_id", "text") if number else numbered(documents.select("doc_id", "text"))
    every = _kept(_texts(documents).select("rid", "doc_id", "n_points", "n_bytes", "h", F.sha2("plain", 256).alias("text_sha256")), folder, "rows")
    shared = _kept(every.groupBy("n_bytes", "h").count().where("count > 1").select("n_bytes", "h"), folder, "shared")
    few = shared.count() <= BROADCAST_KEYS
    found = _texts(documents).join(F.broadcast(shared) if few else shared, ["n_bytes", "h"], "left_semi")
    n_blocks = F.greatest(F.lit(1), F.ceil(F.col("n_bytes") / block).cast("int"))
    cut = found.select("rid", "n_bytes", n_blocks.alias("n_blocks"), F.col("plain").cast("binary").alias("plain"))
    cut = cut.select("rid", "n_bytes", "n_blocks", "plain", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("at"))
    rows = _kept(cut.select("rid", "n_bytes", "n_blocks", "at", F.substring("plain", F.col("at") * block + 1, F.lit(block)).alias("block")), folder, "blocks")
    level, done = 0, None
    named = _named(rows, ["block"], folder, "level0")
    while True:
        ready = named.where("n_blocks = 1").select("rid", "n_bytes", F.lit(level).alias("level"), "name")
        done = ready if done is None else done.unionByName(ready)
        open_ = named.where("n_blocks > 1")
        if open_.isEmpty():
            return every, done
        level += 1
        side = lambda odd: F.max(F.when(F.col("at") % 2 == odd, F.col("name")))
        pairs = open_.groupBy("rid", "n_bytes", F.ceil(F.col("n_blocks") / 2).cast("int").alias("n_blocks"), F.floor(F.col("at") / 2).cast("int").alias("at")).agg(side(0).alias("a"), F.coalesce(side(1), F.lit(-1).cast("long")).alias("b"))
        named = _named(_kept(pairs, folder, f"pairs{level}"), ["a", "b"], folder, f"level{level}")


def exact_duplicates(documents: DataFrame, block: int = BLOCK, number: str | None = None) -> DataFrame:
    """(rid, doc_id, keep_id, group_size, kept, text_sha256) for each row; rid is the row's number, of column ``number`` if given."""
    folder = scratch(documents.sparkSession, "names")
    every, names = identities(documents, folder, block, number)
    best = F.min(F.struct((-F.col("n_points")).alias("n"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid"))
    found = names.join(every.select("rid", "doc_id", "n_points"), "rid")
    keys = ["n_bytes", "level", "name"]
    groups = found.groupBy(keys).agg(best.alias("best"), F.count("*").alias("size"))
    groups = _kept(groups.where("size > 1").select(*keys, F.col("best.doc_id").alias("keep_id"), F.col("best.rid").alias("keep_rid"), "size"), folder, "groups")
    members = spread_join(names, groups.withColumn("_n", F.col("size")), keys, ["rid"], names.count()).select("rid", "keep_id", "keep_rid", "size")
    out = every.join(members, "rid", "left")
    alone = F.col("keep_rid").isNull()
    return out.select("rid", "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("size", F.lit(1).cast("long")).alias("group_size"), (alone | (F.col("rid") == F.col("keep_rid"))).alias("kept"), "text_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read_table(spark, sf_dir, "documents", "doc_id", "text")).drop("rid")


SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(length(text), 0) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS plain
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY plain) AS group_size,
  rid = first_value(rid) OVER w AS kept, sha256(plain) AS text_sha256
FROM t
WINDOW w AS (PARTITION BY plain ORDER BY n DESC, doc_id NULLS LAST, rid ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""
