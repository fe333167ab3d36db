"""Operator 11: the prefix trie of conversations, level by level.

Conversations with equal turns throughout are one, with a weight; a digest of 256 bits, made of digests of ``BLOCK`` turns
and so on, says which. Then, depth by depth, the live conversations are grouped by (parent node, next turn); the least
conv_id of a group names its node, and an equi-join, which deals a frequent turn's conversations to several tasks, takes
them to it. A node with one distinct conversation has no branch below it: its conversation leaves the loop and the rest
of it is a chain, so that the levels gone through are as many as distinct conversations share, not as the longest has. On
the way back each level's leaves and savings are added up by parent and joined to the level above.

Turns compare by 256 bits of (role, text). A conversation's turns are rows, ranked by ranges of (conv_id, turn), and
never gathered. A node's own conversations are hashed as one stream in order, ``1 << CHUNK`` ids a row: SHA-256 has no
parallel form, so a group of copies is one task's stream there, of ids only and in bounded memory.

Null roles and texts are empty. Turns sort with nulls first, tied turns by the digest of role and text; repeated rows are
turns of their own. Rows with a null conv_id belong to no conversation and are left out. A conversation without turns is
a member of the root only. An empty table has no root and gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, read_table, scratch, spread_join
from .turns import CRC_TABLE, crc32, crc_sql, kept, ranked, turn_key

BLOCK, CHUNK = 1024, 12
#: Fixed values of the registered query: conversations of a hundred share the first turns of its first one, up to five.
HUNDRED, HEADS = 100, 6

_NONE = hashlib.sha256(b"").hexdigest()


def turns_of(conversations: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """((conv_id, rank, key, points), (conv_id, first, n)): every turn in order, each conversation's first rank and turns."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), turn_key(role, text).alias("key"), F.length(text).cast("long").alias("points"))
    turns = ranked(rows, folder).drop("turn")
    return turns, kept(turns.groupBy("conv_id").agg(F.min("rank").alias("first"), F.count("*").alias("n")), folder, "convs")


def plain_turns(conversations: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """((conv_id, depth, key, points), (conv_id)) of the conversations as they are."""
    turns, convs = turns_of(conversations, folder)
    return turns.join(convs, "conv_id").select("conv_id", (F.col("rank") - F.col("first") + 1).alias("depth"), "key", "points"), convs.select("conv_id")


def rebuilt_turns(conversations: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """As ``plain_turns``, each conversation with its first h turns taken from the first conversation of its hundred; h is the CRC-32 of conv_id, modulo 6."""
    turns, convs = turns_of(conversations, folder)
    own = convs.withColumns({"h": crc32(F.col("conv_id").cast("string")) % HEADS, "base": F.col("conv_id") - F.col("conv_id") % HUNDRED})
    bases = convs.where(F.col("conv_id") % HUNDRED == 0).select(F.col("conv_id").alias("base"), F.col("first").alias("base_first"), F.col("n").alias("base_n"))
    own = own.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0).cast("long"))))
    at = F.col("rank") - F.col("first")
    rest = turns.join(own.select("conv_id", "first", "h", "taken"), "conv_id").where(at >= F.col("h")).select("conv_id", (F.col("taken") + at - F.col("h") + 1).alias("depth"), "key", "points")
    head = turns.where(F.col("conv_id") % HUNDRED == 0).join(bases, F.col("conv_id") == F.col("base")).where(F.col("rank") - F.col("base_first") < HEADS - 1)
    head = head.select("base", (F.col("rank") - F.col("base_first") + 1).alias("depth"), "key", "points").join(own.select("conv_id", "base", "h"), "base").where("depth <= h")
    return rest.unionByName(head.select("conv_id", "depth", "key", "points")), convs.select("conv_id")


def _identities(turns: DataFrame, block: int) -> DataFrame:
    """(conv_id, n, digest): digests of ``block`` turns, then of as many digests, until each conversation has one."""
    digest = F.unhex(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("depth", "key"))), lambda x: F.hex(x["key"])), ""), 256))
    most = turns.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    rows = turns.select("conv_id", "depth", "key", F.lit(1).cast("long").alias("n"))
    while True:
        part = F.expr(f"(depth - 1) div {block} + 1").alias("depth")
        rows = rows.groupBy("conv_id", part).agg(digest.alias("key"), F.sum("n").alias("n"))
        most = -(-most // block)
        if most <= 1:
            return rows.select("conv_id", "n", F.col("key").alias("digest"))


def _digests(members: DataFrame) -> DataFrame:
    """(rep, ends_sha256): the ids of each rep in order, comma-joined, hashed as a stream."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    chunks = members.groupBy("rep", F.shiftright("conv_id", CHUNK).alias("part")).agg(joined.alias("ids"))
    chunks = chunks.repartition(partitions(members.sparkSession), "rep").sortWithinPartitions("rep", "part").select("rep", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        reps, sums = [], []
        for batch in batches:
            for rep, ids in zip(batch.column("rep").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if state is not None and rep == last:
                    state.update(b",")
                else:
                    if state is not None:
                        reps.append(last)
                        sums.append(state.hexdigest())
                    last, state = rep, hashlib.sha256()
                state.update(ids.encode())
            yield pa.RecordBatch.from_pydict({"rep": pa.array(reps, pa.int64()), "ends_sha256": pa.array(sums, pa.string())})
            reps, sums = [], []
        if state is not None:
            yield pa.RecordBatch.from_pydict({"rep": pa.array([last], pa.int64()), "ends_sha256": pa.array([state.hexdigest()], pa.string())})

    return chunks.mapInArrow(run, "rep long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame, folder: str, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, ends and members of the trie of ``turns`` (conv_id, depth from 1, key, points); ``convs`` has every conv_id.

    Nodes: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens). Ends: (conv_id, depth, rep) of
    nodes at which conversations end. Members: (conv_id, rep) of every conversation; those of a rep end at the same node.
    """
    turns = kept(turns, folder, "turns")
    every = kept(convs.join(_identities(turns, block), "conv_id", "left").select("conv_id", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("digest", F.lit(b"")).alias("digest")), folder, "identities")
    groups = kept(every.groupBy("digest").agg(F.min("conv_id").alias("rep"), F.count("*").alias("weight"), F.min("n").alias("n")), folder, "groups")
    total, root = groups.agg(F.coalesce(F.sum("weight"), F.lit(0)), F.min("rep")).first()
    members = spread_join(every.select("conv_id", "digest"), groups.select("digest", "rep", F.col("weight").alias("_n")), ["digest"], ["conv_id"], total).select("conv_id", "rep")
    reps = groups.select("rep", "weight", "n")
    own = turns.join(reps.select(F.col("rep").alias("conv_id")), "conv_id", "left_semi").withColumnRenamed("conv_id", "rep")
    turns = kept(own.sortWithinPartitions("depth"), folder, "distinct")  # a level reads the pages of its depth

    # forward: at each depth the groups of (node above, next turn)
    here = reps.where("n > 0").select("rep", F.lit(root).cast("long").alias("node"), "weight", "n")
    ends = reps.where("n = 0").select(F.col("rep").alias("conv_id"), F.lit(0).cast("long").alias("depth"), "rep")
    levels: list[DataFrame] = []
    while True:
        depth = len(levels) + 1
        step = here.join(turns.where(F.col("depth") == depth).drop("depth"), "rep").withColumnRenamed("node", "parent")
        found = step.groupBy("parent", "key").agg(F.min("rep").alias("node"), F.count("*").alias("_n"), F.sum("weight").alias("n_convs"), F.min("points").alias("points"), F.max("n").alias("n"))
        levels.append(kept(found.withColumn("depth", F.lit(depth).cast("long")), folder, f"level{depth}"))
        shared = levels[-1].where("_n > 1")
        n_live = shared.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
        if not n_live:
            break
        here = kept(spread_join(step, shared.select("parent", "key", "node", "_n"), ["parent", "key"], ["rep"], n_live).select("rep", "node", "weight", "n"), folder, f"live{depth}")
        ends = ends.unionByName(here.where(F.col("n") == depth).select(F.col("node").alias("conv_id"), F.lit(depth).cast("long").alias("depth"), "rep"))

    # chains: what is below a node with one distinct conversation
    alone = levels[0]
    for level in levels[1:]:
        alone = alone.unionByName(level)
    alone = kept(alone.where("_n = 1").select("node", "depth", "parent", "n_convs", "points", "n"), folder, "alone")
    ends = ends.unionByName(alone.select(F.col("node").alias("conv_id"), F.col("n").alias("depth"), F.col("node").alias("rep")))
    chain = turns.join(alone.select(F.col("node").alias("rep"), F.col("depth").alias("top"), "n_convs", "n"), "rep").where("depth > top")
    chain = chain.select(F.col("rep").alias("conv_id"), "depth", F.col("rep").alias("parent_conv_id"), "n_convs", (F.col("depth") < F.col("n")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("points")).alias("saved"))
    below = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    copies, single = chain.where("n_convs > 1"), chain.where("n_convs = 1")  # one conversation alone saves nothing, however long
    deep = copies.groupBy(F.col("conv_id").alias("node")).agg(F.sum("saved").alias("deep"))
    chain = single.withColumnRenamed("saved", "saved_tokens").unionByName(copies.withColumn("saved_tokens", F.sum("saved").over(below)).drop("saved"))
    tops = alone.join(deep, "node", "left").select(F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", (F.col("depth") < F.col("n")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("points") + F.coalesce("deep", F.lit(0).cast("long"))).alias("saved_tokens"))
    tops = kept(tops, folder, "tops")

    # backward: leaves and savings of each level by parent, joined to the level above
    zero = F.lit(0).cast("long")
    out, under = chain.unionByName(tops), None
    for depth in range(len(levels), -1, -1):
        kids = tops.where(F.col("depth") == depth + 1)
        kids = kids if under is None else kids.unionByName(under)
        up = kids.groupBy(F.col("parent_conv_id").alias("node")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"))
        if depth:
            level = levels[depth - 1].where("_n > 1").select("node", "depth", "parent", "n_convs", "points")
        else:
            level = groups.groupBy().agg(F.min("rep").alias("node"), F.sum("weight").alias("n_convs")).where("n_convs > 0").select("node", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent"), "n_convs", zero.alias("points"))
        rolled = level.join(up, "node", "left").select(F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", zero).alias("n_children"), F.coalesce("n_leaves", F.lit(1).cast("long")).alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("points") + F.coalesce("below", zero)).alias("saved_tokens"))
        under = kept(rolled, folder, f"rolled{depth}")
        out = out.unionByName(under)
    return out, ends, members


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "trie")
    conversations = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    nodes, ends, members = prefix_trie(*rebuilt_turns(conversations, folder), folder)
    sums = ends.join(_digests(members), "rep").drop("rep")
    return nodes.join(sums, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NONE)))


SQL = f"""
WITH {CRC_TABLE},
o AS (
  SELECT conv_id, key, length(text) AS points, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key) - 1 AS i
  FROM (SELECT conv_id, turn, text, sha256(strlen(role) || ':' || role || text) AS key
    FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL))),
c AS (SELECT conv_id, n, {crc_sql("conv_id::VARCHAR")} % {HEADS} AS h, conv_id - conv_id % {HUNDRED} AS base FROM (SELECT conv_id, count(*) AS n FROM o GROUP BY conv_id), crc_table),
r AS (
  SELECT o.conv_id, least(c.h, coalesce(b.n, 0)) + i - c.h + 1 AS depth, key, points
  FROM o JOIN c USING (conv_id) LEFT JOIN c AS b ON b.conv_id = c.base WHERE i >= c.h
  UNION ALL
  SELECT c.conv_id, i + 1, key, points FROM c JOIN o ON o.conv_id = c.base AND i < h),
m AS (
  SELECT conv_id, depth, string_agg(key, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path, points FROM r
  UNION ALL SELECT conv_id, 0, '', 0 FROM c),
node AS (SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(points) AS points FROM m GROUP BY depth, path),
kids AS (SELECT depth - 1 AS depth, left(path, length(path) - 64) AS path, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY ALL),
full_ AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (depth, path)),
below AS (
  SELECT m.depth, m.path, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * full_.points)::BIGINT AS saved_tokens
  FROM m JOIN full_ ON m.conv_id = full_.conv_id AND m.depth <= full_.depth GROUP BY m.depth, m.path),
ends AS (
  SELECT depth, path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256
  FROM (SELECT conv_id, max(depth) AS depth, max_by(path, depth) AS path FROM m GROUP BY conv_id) GROUP BY depth, path)
SELECT f.conv_id, depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM full_ AS f JOIN below USING (depth, path) LEFT JOIN ends USING (depth, path)
LEFT JOIN node AS p ON p.depth = f.depth - 1 AND p.path = left(f.path, greatest(length(f.path) - 64, 0)) AND f.depth > 0
"""
