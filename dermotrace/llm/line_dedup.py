"""Operator 13: lines that many documents share, by exploded hashes; DataFrame operations only.

A text is split at line feeds. A line's key is the line without white space at both ends, A-Z lower-cased; keys of
``MIN_POINTS`` code points or more are hashed (128 bits of SHA-256). Each document gives each of its hashes once, so that
one grouping, combined before its shuffle, counts documents and finds the largest doc_id. Hashes found in ``MIN_DOCS``
documents or more meet the lines again: by broadcast while there are few, else by a join that deals a hot hash's lines to
several tasks. What is left is a list of dropped positions for each document that loses lines, and the text is put
together from the other positions; a document's own lines are all that ever comes together.

A row is a document: rows that share a doc_id count one by one, and all rows with the largest doc_id of a key keep it. A
null doc_id is the smallest. A null or empty text is one empty line. Lines that repeat within a document count once and
are dropped or kept together. A text of any length is one row. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, numbered, read_table, scratch, spread_join

MIN_POINTS, MIN_DOCS = 20, 3
#: Up to so many shared hashes of 16 bytes are broadcast; more are joined by shuffle.
BROADCAST_KEYS = 200_000
#: The characters that are stripped.
SPACES = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(SPACES))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(ascii_lower(bare))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hashes(text: Column, min_points: int) -> Column:
    """A hash for each line, null for a short one."""
    return F.transform(_lines(text), lambda x: F.when(F.length(F.btrim(x, F.lit(SPACES))) >= min_points, F.substring(F.sha2(line_key(x), 256), 1, 32)))


def shared_lines(rows: DataFrame, min_points: int = MIN_POINTS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(key, n_docs, keep_id) of the keys found in ``min_docs`` rows of (doc_id, text) or more; key is 16 bytes of hash."""
    once = rows.select("doc_id", F.explode(F.array_distinct(_hashes(F.col("text"), min_points))).alias("key")).where("key is not null")
    return once.groupBy(F.unhex("key").alias("key")).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keep_id")).where(F.col("n_docs") >= min_docs)


def drop_shared_lines(documents: DataFrame, min_points: int = MIN_POINTS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept) for each row of ``documents``; kept is the text that stays."""
    spark = documents.sparkSession
    rows = numbered(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    found = shared_lines(rows, min_points, min_docs)
    path = scratch(spark, "lines")
    found.write.parquet(path)
    shared = spark.read.schema(found.schema).parquet(path)
    n_keys, n_rows = shared.agg(F.count("*"), F.coalesce(F.sum("n_docs"), F.lit(0))).first()

    lines = rows.select("rid", "doc_id", F.posexplode(_hashes(F.col("text"), min_points)).alias("at", "hex")).where("hex is not null")
    lines = lines.select("rid", "doc_id", "at", F.unhex("hex").alias("key"))
    if n_keys <= BROADCAST_KEYS:
        met = lines.join(F.broadcast(shared.drop("n_docs")), "key")
    else:
        met = spread_join(lines, shared.withColumnRenamed("n_docs", "_n"), ["key"], ["rid"], n_rows)
    lost = met.where("keep_id is not null and (doc_id is null or doc_id < keep_id)").groupBy("rid").agg(F.collect_list("at").alias("lost"))

    split = rows.join(lost, "rid", "left").select("doc_id", "text", "lost", _lines(F.col("text")).alias("lines"))
    # lines are read by position in two places, so that they are split once and not for each position
    n_lines = F.size("lines")
    stay = F.array_except(F.sequence(F.lit(0), n_lines - 1), F.col("lost"))
    kept = F.when(F.col("lost").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n"))
    return split.select("doc_id", n_lines.cast("long").alias("n_lines"), F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_shared_lines(read_table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (
  SELECT rid, doc_id, u.i AS i, lines[u.i] AS line,
    translate(regexp_replace(lines[u.i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM d, unnest(range(1, len(lines) + 1)) AS u(i)),
shared AS (
  SELECT key, max(doc_id) AS keep_id FROM (SELECT DISTINCT rid, doc_id, key FROM l WHERE length(key) >= 20)
  GROUP BY key HAVING count(*) >= 3)
SELECT l.doc_id, count(*) AS n_lines,
  count(*) FILTER (keep_id IS NOT NULL AND (l.doc_id IS NULL OR l.doc_id < keep_id)) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (keep_id IS NULL OR l.doc_id >= keep_id), '')) AS kept_sha256
FROM l LEFT JOIN shared USING (key)
GROUP BY l.rid, l.doc_id
"""
