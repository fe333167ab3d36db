"""Tags of responses against a loop over all impulses, and SQL."""

import random

import pytest

import oracle
from dermotrace.operators import responses


def plain(peaks, impulses):
    out = {}
    for track, idx, t, onset in peaks:
        start = t - 1.5 if onset is None else onset
        own = [i for i in impulses if i[0] == track]
        inside = [i for i in own if start - 0.5 <= i[2] <= t]
        near = [i for i in own if abs(i[2] - start) <= 2]
        best = max(inside, key=lambda i: (i[3], -i[2], -i[1])) if inside else min(near, key=lambda i: (abs(i[2] - start), i[2], i[1])) if near else None
        out[track, idx] = (best and best[1], len(inside) or int(bool(near)), *(best[4:] if best else ("typical", 1.0, 2)))
    return out


@pytest.mark.parametrize("bucket", [0.5, 4.0, 1000.0])
def test_against_plain(spark, bucket):
    """Intervals within a bucket, over two and over hundreds; ties in height and distance."""
    rng = random.Random(bucket)
    peaks = [(k % 3, k, t := round(rng.uniform(0, 300), 1), rng.choice([None, t, t - 0.4, t - rng.uniform(0, 5), t - rng.uniform(0, 290)])) for k in range(120)]
    impulses = [(rng.randrange(3), k, round(rng.uniform(0, 300) * 2) / 2, float(rng.randrange(4)), rng.choice(responses.LABELS), rng.random(), rng.randrange(5)) for k in range(150)]
    a = spark.createDataFrame(peaks, "track long, idx long, t double, onset double").repartition(3)
    b = spark.createDataFrame(impulses, "track long, idx long, t double, height double, label string, scale double, band int").repartition(3)
    got = {(r.track, r.idx): (r.impulse, r.n_impulses, r.label, r.scale, r.band) for r in responses.tagged(a, b, bucket).collect()}
    assert got == plain(peaks, impulses)


@pytest.mark.parametrize("name", sorted(responses.QUERIES))
def test_sql(spark, name):
    oracle.same(responses.QUERIES[name](spark, "/root/testdata/sf0.001"), responses.ORACLE_SQL[name], "/root/testdata/sf0.001")
