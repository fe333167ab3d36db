"""Greedy choices along a track, each resting on the one before, without gathering the track.

Every row knows its successor, the row that would be chosen next if this one were. What is chosen from the first row is
its orbit. Blocks of ``WIDTH`` rows are walked on their own: each row's way out of its block gives a successor among the
few rows at which other blocks are entered, and these are dealt into blocks of blocks, until one block holds a track; on
the way back the entered rows of each block are walked again. A group is a block, whatever the track's length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut

WIDTH = 4096


def first_at(rows: DataFrame, keys: list[str], value: str, by: float, strict: bool = False) -> DataFrame:
    """``rows`` (keys, r, value ascending with r) with ``succ``: the first row at least (strict: more than) ``by`` further; one union, one window."""
    none = F.lit(None).cast("long")
    both = rows.select(*keys, F.lit(0).alias("_side"), F.col(value).alias("_v"), F.col("r").alias("_row"), none.alias("r"))
    both = both.unionByName(rows.select(*keys, F.lit(-1 if strict else 1).alias("_side"), (F.col(value) + by).alias("_v"), none.alias("_row"), F.col("r").alias("r")))
    w = Window.partitionBy(*keys).orderBy(F.desc("_v"), "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("succ", F.min("_row").over(w)).where("r is not null").select(*keys, "r", "succ")
    return rows.join(found, [*keys, "r"])


def _indexed(table: pa.Table) -> tuple[pa.Table, np.ndarray, list]:
    table = table.sort_by("r")
    return table, table.column("r").to_numpy(), table.column("succ").to_pylist()


def _ways_out(keys: list[str], schema: pa.Schema):
    def run(table: pa.Table) -> pa.Table:
        table, r, succ = _indexed(table)
        at = {int(x): k for k, x in enumerate(r)}
        for k in range(len(succ) - 1, -1, -1):  # a successor comes later, so its own way out is known
            if succ[k] in at:
                succ[k] = succ[at[succ[k]]]
        return pa.table({**{c: table.column(c) for c in keys}, "r": pa.array(r), "succ": pa.array(succ, pa.int64())}).cast(schema)

    return run


def _orbit(keys: list[str], schema: pa.Schema):
    def run(table: pa.Table) -> pa.Table:
        table, r, succ = _indexed(table)
        at, marked = {int(x): k for k, x in enumerate(r)}, [k for k, x in enumerate(table.column("begins").to_pylist()) if x]
        k, found = (marked[0] if marked else None), []
        while k is not None:
            found.append(k)
            k = at.get(succ[k])
        return table.select([*keys, "r"]).take(pa.array(found, pa.int64())).cast(schema)

    return run


def followed(rows: DataFrame, keys: list[str], width: int = WIDTH) -> DataFrame:
    """(keys, r) of the rows chosen: ``rows`` has keys, r from 0 on and succ, a later r or null."""
    kinds = dict(rows.dtypes)
    ddl = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", r long"
    arrow = lambda *more: pa.schema([*(pa.field(f.name, f.type) for f in empty.schema if f.name in keys), pa.field("r", pa.int64()), *(pa.field(c, pa.int64()) for c in more)])
    level = cut(rows.select(*keys, F.col("r").cast("long").alias("r"), F.col("succ").cast("long").alias("succ")))
    empty = level.limit(0).toArrow()
    last = level.agg(F.max("r")).first()[0] or 0
    block, below = width, []
    while last // block:
        part = F.expr(f"r div {block}L").alias("block")
        out = cut(level.groupBy(*keys, part).applyInArrow(_ways_out(keys, arrow("succ")), f"{ddl}, succ long"))
        below.append((level, block))
        entered = out.where("succ is not null").select(*keys, F.col("succ").alias("r")).unionByName(out.where("r = 0").select(*keys, "r")).distinct()
        level = cut(out.join(entered, [*keys, "r"], "left_semi"))
        block *= width
    chosen = level.withColumn("begins", F.col("r") == 0).groupBy(*keys).applyInArrow(_orbit(keys, arrow()), ddl)
    for level, block in reversed(below):
        begun = level.join(cut(chosen).withColumn("begins", F.lit(True)), [*keys, "r"], "left")
        chosen = begun.groupBy(*keys, F.expr(f"r div {block}L").alias("block")).applyInArrow(_orbit(keys, arrow()), ddl)
    return chosen


def gated(rows: DataFrame, keys: list[str], value: Column, step: float, order: list, width: int = WIDTH) -> DataFrame:
    """Rows at least ``step`` further in ``value`` (ascending in ``order``) than the one kept before; the first of each group stays."""
    numbered = rows.withColumns({"r": F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long") - 1, "_value": value})
    kept = followed(first_at(numbered.select(*keys, "r", "_value"), keys, "_value", step), keys, width)
    return numbered.join(kept, [*keys, "r"]).drop("r", "_value")
