"""Inference against plain versions: serial correlation, tests, pooled correlations with their p-values."""

import math

import numpy as np
import pytest

from dermotrace.functions import stats
from dermotrace.operators import inference
from pyspark.sql import functions as F


def lags(x, k):
    d = x - x.mean()
    return sum(d[i] * d[i + k] for i in range(len(x) - k)) / sum(v * v for v in d)


def plain_inflation(a, b):
    n = len(a)
    if n < 8 or not a.var() or not b.var():
        return 1.0
    total = 0.0
    for k in range(1, max(1, n // 5) + 1):
        ra, rb = lags(a, k), lags(b, k)
        if abs(ra) < 2 / math.sqrt(n) and abs(rb) < 2 / math.sqrt(n):
            break
        total += (1 - k / n) * (ra if a is b else ra * rb)
    return max(1.0, 1 + 2 * total)


@pytest.mark.parametrize("n", [1, 5, 8, 40, 300])
def test_effective_sizes(n):
    rng = np.random.default_rng(n)
    a, b = np.cumsum(rng.normal(size=n)), np.cumsum(rng.normal(size=n))
    assert inference.inflation(a) == pytest.approx(plain_inflation(a, a))
    assert inference.inflation(a, b) == pytest.approx(plain_inflation(a, b))
    assert inference.effective(np.full(n, 2.0)) == n
    assert inference.autocorrelation(a, 5)[0] == (1 if n > 1 else 0)


def series(seed, walks, n=120):
    rng, rows = np.random.default_rng(seed), []
    for w in range(walks):
        x, z = np.cumsum(rng.normal(size=n)), np.cumsum(rng.normal(size=n))
        y = 0.5 * x + np.cumsum(rng.normal(size=n)) + z
        rows += [(w, float(i), i, float(x[i]), float(y[i]), float(z[i]), float(rng.normal())) for i in range(n)]
    return rows


SCHEMA = "track long, t double, idx long, x double, y double, z double, u double"


def test_pooled_and_tested(spark):
    for walks in (2, 4, 7):
        rows = series(walks, walks)
        df = spark.createDataFrame(rows, SCHEMA)
        got = {r.track: r for r in inference.walk_correlations(df, "x", "y").collect()}
        entries = []
        for w in range(walks):
            x, y = (np.array([r[k] for r in rows if r[0] == w]) for k in (3, 4))
            r = float(np.corrcoef(x, y)[0, 1])
            n_eff = max(2, min(120, 120 / plain_inflation(x, y)))
            assert (got[w].r, got[w].n_eff) == (pytest.approx(r), pytest.approx(n_eff))
            want = stats.t_p_value(r * math.sqrt((n_eff - 2) / (1 - r * r)), n_eff - 2) if n_eff > 3 else 1.0
            assert got[w].p == pytest.approx(want)
            if n_eff >= 4:
                entries.append((r, math.atanh(r), n_eff - 3))
        made = inference.pooled(inference.walk_correlations(df, "x", "y"), []).first()
        if not entries:
            assert made is None
            continue
        k = len(entries)
        assert made.k == k
        if k < 3:
            assert made.r == pytest.approx(np.mean([e[0] for e in entries])) and made.p == 1.0 and made.tau2 is None
            continue
        z, w = (np.array([e[i] for e in entries]) for i in (1, 2))
        q = float((w * (z - (w @ z) / w.sum()) ** 2).sum())
        tau2 = max(0.0, (q - (k - 1)) / (w.sum() - (w * w).sum() / w.sum()))
        v = 1 / (1 / w + tau2)
        mean = float(v @ z / v.sum())
        se = max((1 / v.sum()) ** 0.5, (float((v * (z - mean) ** 2).sum()) / ((k - 1) * v.sum())) ** 0.5)
        assert (made.r, made.tau2, made.se) == (pytest.approx(math.tanh(mean)), pytest.approx(tau2), pytest.approx(se))
        assert made.p == pytest.approx(stats.t_p_value(mean / se, k - 1)) and made.method == ("meta" if k >= 5 else "metaProvisional")


def test_partial(spark):
    rows = series(3, 1)
    x, y, z = (np.array([r[k] for r in rows]) for k in (3, 4, 5))
    res = lambda a: a - np.polyval(np.polyfit(z, a, 1), z)
    got = inference.partial_correlations(spark.createDataFrame(rows, SCHEMA), "x", "y", "z").first()
    assert got.r == pytest.approx(np.corrcoef(res(x), res(y))[0, 1]) and got.raw_r == pytest.approx(np.corrcoef(x, y)[0, 1])
    n_eff = max(2, min(120, 120 / plain_inflation(res(x), res(y))))
    assert got.p == pytest.approx(stats.t_p_value(got.r * math.sqrt((n_eff - 3) / (1 - got.r**2)), n_eff - 3) if n_eff > 4 else 1.0)
    still = spark.createDataFrame([(*r[:5], 1.0, r[6]) for r in rows], SCHEMA)
    assert inference.partial_correlations(still, "x", "y", "z").first().r == pytest.approx(got.raw_r)


def test_matrix_q_values(spark):
    df = spark.createDataFrame(series(5, 8), SCHEMA).withColumn("flat", F.lit(3.0))
    got = inference.feature_matrix(df, ["x", "u", "flat"], ["y"]).collect()
    assert {r.feature for r in got} <= {"x", "u", "flat"}
    tested = sorted((r.p, r.q) for r in got if r.q is not None)
    m, want, low = len(tested), [], 1.0
    for i in range(m - 1, -1, -1):
        low = min(low, tested[i][0] * m / (i + 1))
        want.append(low)
    assert [q for _, q in tested] == pytest.approx(want[::-1])
    assert all(r.q is None for r in got if not r.varies or r.method != "meta")


def test_classes_and_extremes(spark):
    rng = np.random.default_rng(9)
    rows = [(w, float(i), i, float(rng.normal() + (i // 40) + w * 0.1), "abc"[i // 40]) for w in range(3) for i in range(120)] + [(9, 0.0, 0, 5.0, "few"), (9, 1.0, 1, 5.0, "unclassified")]
    df = spark.createDataFrame(rows, "track long, t double, idx long, value double, road string")
    profile = inference.class_profile(df, "road", "value", df.where("value > 3").select("road"))
    got = profile.collect()
    assert [r.road for r in got] == ["c", "b", "a"]
    assert all(r.half_width == pytest.approx(stats.t_critical(r.df) * r.se) for r in got)
    assert got[0].peaks_a_minute == pytest.approx(sum(1 for r in rows if r[4] == "c" and r[3] > 3) / 2)
    e = inference.compare_extremes(profile, "road").first()
    assert (e.high, e.low, e.groups) == ("c", "a", 3) and e.p_adjusted == pytest.approx(min(1, 3 * e.p))
    assert inference.compare_extremes(profile.where("road = 'a'"), "road").count() == 0


def test_small_rules(spark):
    r = spark.range(1).select(inference.as_binary(F.lit("true")).alias("a"), inference.as_binary(F.lit(0)).alias("b"), inference.as_binary(F.lit(2)).alias("c"), inference.strength(F.lit(-0.25)).alias("d"), inference.valid(F.lit(999.0)).alias("e")).first()
    assert tuple(r) == (1.0, 0.0, None, "moderate", False)
