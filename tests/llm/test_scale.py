"""What one key, value or benchmark of unusual size does to the operators."""

import resource
import time

import numpy as np
import pyarrow as pa

from dermotrace.llm import common, components, decontaminate, simhash
from pyspark.sql import functions as F


def roots(spark, values, **options):
    df = spark.createDataFrame(pa.table({"fp": pa.array(np.asarray(values, np.uint64).view(np.int64))}))
    return {r.node: r.root for r in components.components(simhash.links(df, **options)).collect()}


def test_hot_value(spark):
    """100,000 fingerprints of one 32-bit value, with planted links of up to four bits."""
    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(0, 1 << 32, 100_000, np.uint64)) | np.uint64(0xABCD1234 << 32)
    near = []
    for k, x in enumerate(base[:400].tolist()):
        for b in rng.choice(64, k % 4 + 1, replace=False):
            x ^= 1 << int(b)
        near.append(x)
    values = np.unique(np.concatenate((base, np.array(near, np.uint64))))
    began = time.time()
    root = roots(spark, values)
    assert time.time() - began < 240
    signed = lambda x: int(np.uint64(x).view(np.int64))
    for a, b in zip(base[:400].tolist(), near):
        assert root[signed(a)] == root[signed(b)]
    linked = {int(np.int64(x).view(np.uint64)) for x in root}
    sample = [int(x) for x in rng.choice(values, 300)]
    for x in sample:
        has = (np.bitwise_count(values ^ np.uint64(x)) <= 4).sum() > 1
        assert has == (x in linked)


def test_hot_values_against_brute_force(spark):
    """So small a limit that every value is filed again; dense and sparse groups."""
    rng = np.random.default_rng(6)
    centre = rng.integers(0, 1 << 63, 6, np.uint64)
    values = {int(c) ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for c in centre for k in (1, 2, 3, 5, 7) for _ in range(25)}
    values = np.array(sorted(values), np.uint64)
    link = np.bitwise_count(values[:, None] ^ values[None, :]) <= 4
    label = np.arange(values.size)
    while True:
        new = np.where(link, label[None, :], values.size).min(axis=1)
        if (new == label).all():
            break
        label = new
    for hot in (3, 40, 4000):
        root = roots(spark, values, hot=hot)
        got = [root.get(int(v.view(np.int64)), int(v.view(np.int64))) for v in values]
        assert len(set(got)) == len(set(label.tolist())) == len(set(zip(got, label.tolist())))


def test_links_fold():
    """Folding links while they are found changes no component and ends early in a dense group."""
    rng = np.random.default_rng(7)
    fp = np.unique(rng.integers(0, 1 << 9, 400, np.uint64))
    key = np.zeros(fp.size, np.uint64)
    old = simhash.FOLD
    try:
        made = []
        for simhash.FOLD in (50, 1 << 20):
            a, b = simhash.forest(*simhash._links(key, fp, 4, False))
            made.append(dict(zip(a.tolist(), b.tolist())))
    finally:
        simhash.FOLD = old
    assert made[0] == made[1]


def test_spread_join(spark):
    """A hot key's rows are dealt to several places and each meets the key's row once."""
    many = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    one = many.groupBy("k").agg(F.count("*").alias("_n"), F.min("v").alias("least"))
    got = common.spread_join(many, one, ["k"], ["v"], 20_000)
    assert got.columns == ["k", "v", "least"]
    assert got.count() == 20_000 and got.where("k = 7").count() == 6667 + 1 - (7 % 3 == 0)
    assert got.where("k != 7 and least != v").count() == 0 and got.where("k = 7 and least != 0").count() == 0


def test_numbered(spark, tmp_path):
    """Rows of files are numbered as they are; rows behind a shuffle are written first."""
    spark.range(1000).select("id", F.col("id").alias("x")).write.parquet(str(tmp_path / "in"))
    plain = spark.read.parquet(str(tmp_path / "in"))
    assert "Exchange" not in common.numbered(plain)._jdf.queryExecution().executedPlan().toString()
    dealt = common.numbered(plain.repartition(5))
    assert "Exchange" not in dealt._jdf.queryExecution().executedPlan().toString()
    assert dealt.select("rid").distinct().count() == 1000 and dealt.columns == ["rid", "id", "x"]


def test_large_benchmark():
    """20 MB of benchmark is one automaton of bounded size, and one scan."""
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i:x}" for i in range(50_000)]
    rows = rng.integers(0, len(vocabulary), (20_000, 170))
    items = [(str(i), " ".join(map(vocabulary.__getitem__, r))) for i, r in enumerate(rows.tolist())]
    size = sum(len(t) for _, t in items)
    assert size > 18_000_000
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    found = decontaminate.Windows(items)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 2_000_000  # kB, the tuples of the build included
    text = f"before {items[77][1]} after {' '.join(items[9_999][1].split()[3:13])} {' '.join(items[5][1].split()[:9])}"
    n, ids, runs = decontaminate.scan(text, found)
    assert (n, ids) == (171 + 1 + 10 + 9, ["77", "9999"]) and runs == [(1, 171), (172, 182)]
