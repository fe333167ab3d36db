"""Greedy choices by blocks against a plain walk."""

import random

import pytest
from pyspark.sql import functions as F

from dermotrace.operators import orbits


def plain(rows, step):
    out, last = [], None
    for g, v, i in sorted(rows):
        if last is None or last[0] != g or v >= last[1] + step:
            out.append((g, i))
            last = (g, v)
    return sorted(out)


@pytest.mark.parametrize("width", [3, 17, 4096])
def test_gates(spark, width):
    """Three levels of blocks and one: the same rows, ties and short groups too."""
    rng = random.Random(width)
    rows, v = [], 0.0
    for i in range(700):
        v += rng.choice([0.0, 0.25, 0.5, 1.0, 7.0])
        rows.append((1, v, i))
    rows += [(2, 5.0, 800), (3, 1.0, 801), (3, 1.0, 802)]
    df = spark.createDataFrame(rows, "g long, v double, i long").repartition(5)
    got = orbits.gated(df, ["g"], F.col("v"), 2.5, ["v", "i"], width)
    assert sorted((r.g, r.i) for r in got.collect()) == plain(rows, 2.5)


def test_no_rows(spark):
    df = spark.createDataFrame([], "g long, v double, i long")
    assert orbits.gated(df, ["g"], F.col("v"), 1.0, ["v", "i"]).collect() == []
