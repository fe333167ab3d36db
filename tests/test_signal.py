"""Kernels and queries of one track's signal against plain loops, over whole tables."""

import math
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dermotrace import registry
from dermotrace.operators import signal, spectral, wavelet
from dermotrace.sources.tables import events

SF = "/root/testdata/sf0.001"


def tracks(spark):
    out = defaultdict(list)
    for r in sorted(events(spark, SF).collect(), key=lambda r: (r.track, r.t, r.idx)):
        out[r.track].append((r.t, r.idx, r.value))
    for rows in out.values():
        last = next((v for *_, v in rows if v is not None), None)
        for i, (t, idx, v) in enumerate(rows):
            last = v if v is not None else last
            rows[i] = (t, idx, last)
    return out


def held(spark, name, column, make):
    """A query's column against a plain function of each whole track."""
    got = {(r.track, r.idx): r[column] for r in registry.queries()[name](spark, SF).collect()}
    seen = 0
    for track, rows in tracks(spark).items():
        want = make([v for *_, v in rows])
        for (_, idx, _), w in zip(rows, want):
            assert got[track, idx] == (pytest.approx(w, rel=1e-6, abs=1e-6) if w is not None else None), (name, track, idx)
            seen += 1
    assert seen == len(got)


def plain_ema(x, window=9):
    a, n = 2 / (window + 1), max(1, round((window + 1) / 2))

    def one(y):
        seed = sorted(y[:n])
        last, out = seed[int(0.1 * (len(seed) - 1))], []
        for v in y:
            last += a * (v - last)
            out.append(last)
        return out

    return one(one(x)[::-1])[::-1]


def plain_lowpass(x, cutoff, fs, order):
    pad = 3 * (order + 1)
    if len(x) <= pad or cutoff >= fs / 2:
        return list(x)
    y = [2 * x[0] - v for v in x[pad:0:-1]] + list(x) + [2 * x[-1] - v for v in x[-2 : -pad - 2 : -1]]
    k = math.tan(math.pi * cutoff / fs)
    for _ in (0, 1):
        for i in range(order // 2):
            q = 1 / (2 * math.sin(math.pi * (2 * i + 1) / (2 * order)))
            d = 1 + k / q + k * k
            b, a = (k * k / d, 2 * k * k / d, k * k / d), (2 * (k * k - 1) / d, (1 - k / q + k * k) / d)
            x1 = x2 = y1 = y2 = y[0]
            out = []
            for v in y:
                w = b[0] * v + b[1] * x1 + b[2] * x2 - a[0] * y1 - a[1] * y2
                x1, x2, y1, y2 = v, x1, w, y1
                out.append(w)
            y = out
        y = y[::-1]
    return y[pad:-pad]


def test_smooth_query(spark):
    held(spark, "signal_smooth", "smooth", plain_ema)


def test_lowpass_query(spark):
    held(spark, "signal_lowpass", "low", lambda x: plain_lowpass(x, 0.1, 1.0, 4))


def test_gait_query(spark):
    held(spark, "signal_gait", "low", lambda x: plain_lowpass(plain_lowpass(x, 0.1, 1.0, 2), 0.1, 1.0, 2))


def plain_prominence(x):
    out = [0.0] * len(x)
    for i in range(1, len(x) - 1):
        if x[i] > x[i - 1] and x[i] >= x[i + 1]:
            left = next((j for j in range(i - 1, -1, -1) if x[j] > x[i]), -1)
            right = next((j for j in range(i + 1, len(x)) if x[j] > x[i]), len(x))
            out[i] = x[i] - max(min(x[left + 1 : i + 1]), min(x[i:right]))
    return out


def test_prominence_query(spark):
    held(spark, "signal_prominence", "prominence", plain_prominence)


def plain_box(x, width):
    if not width > 1:
        return list(x)
    r = ((width + 1) / 2 - 1) / 2
    m, f = int(r), r - int(r)
    for _ in (0, 1):
        out = []
        for i in range(len(x)):
            pairs = [(x[j], 1.0) for j in range(max(0, i - m), min(len(x), i + m + 1))]
            pairs += [(x[j], f) for j in (i - m - 1, i + m + 1) if 0 <= j < len(x)]
            out.append(sum(v * w for v, w in pairs) / sum(w for _, w in pairs))
        x = out
    return x


def plain_responses(x, fs=1.0, threshold=5.0, high=1e9, method="lpf", prominent=False):
    width = max(5, round(45 * fs))
    if method == "lpf":
        tonic = plain_ema(x, width)
    else:
        tonic = []
        for i in range(len(x)):
            part = sorted(x[max(0, i - width // 2) : i + width // 2 + 1])
            tonic.append(part[min(len(part) - 1, int(len(part) * 0.5))])
    half = round(6 * fs)
    low = [min(a - b for a, b in zip(x[max(0, i - half) : i + half + 1], tonic[max(0, i - half) : i + half + 1])) for i in range(len(x))]
    tonic = [a + b for a, b in zip(tonic, plain_box(low, 2 * round(4 * fs) - 1))]
    p = [max(0.0, a - b) for a, b in zip(x, tonic)]
    prom = plain_prominence(p)

    def noise(i):
        d = [x[j] - x[j - 1] for j in range(max(1, i - 1), min(len(x) - 1, i + 1) + 1)]
        if len(d) < 2:
            return 1e-6
        m = sum(d) / len(d)
        return max(1e-6, math.sqrt(max(0, sum(v * v for v in d) / len(d) - m * m)) / math.sqrt(2))

    found = []
    for i in range(1, len(p) - 1):
        if not (p[i] > p[i - 1] and p[i] >= p[i + 1] and 0.001 <= p[i] <= high):
            continue
        if prominent:
            if prom[i] < threshold or p[i] - min(p[max(0, i - 8) : i + 1]) > high:
                continue
            low_, j = i, i
            while j > 0 and p[j] > 0 and i - j < 4 and not (j < i and p[j] >= p[low_] + threshold):
                j -= 1
                if p[j] < p[low_]:
                    low_ = j
            found.append((prom[i], i, low_))
        else:
            j = i
            while j > 0 and p[j] > 0 and i - j < 4 and not (j < i and p[j] < p[j - 1]):
                j -= 1
            if p[i] - p[j] >= threshold and (p[i] - p[j]) / noise(j) >= 2.5:
                found.append((p[i] - p[j], i, j))
    kept = []
    for c in sorted(found, key=lambda c: (-c[0], c[1])):
        if all(abs(c[1] - k[1]) >= 1 for k in kept):
            kept.append(c)
    out = {}
    for _, i, j in kept:
        size, rise = p[i] - p[j], float(i - j)
        back = -1
        for k in range(i + 1, len(p)):
            if p[k] <= p[j] + size / 2:
                back = k
                break
            if k < len(p) - 1 and p[k] < p[k + 1] and p[k] > p[j] + size / 2 + 0.1:
                break
        fall = float(back - i) if back >= 0 else -1.0
        slope, decay = size / rise if rise else 0.0, (p[i] - p[back]) / fall if fall > 0 else 0.0
        snr, skew = size / noise(j), rise / fall if fall > 0 else 0.0
        score, weight = min(1, size / 0.5) * 0.2, 0.2 + 0.15
        score += 0.15 * (1 if snr >= 3 else 0.7 if snr >= 2 else 0.4 if snr >= 1.5 else 0)
        if rise > 0:
            weight, score = weight + 0.15, score + 0.15 * (1 if 0.5 <= rise <= 3 else 0.5 if rise <= 5 else 0)
        if slope > 0:
            weight, score = weight + 0.1, score + 0.1 * (1 if 0.01 <= slope <= 1 else 0.5 if slope <= 3 else 0)
        if fall > 0:
            weight += 0.4
            score += 0.15 * (1 if 0.5 <= fall <= 4 else 0.5 if fall <= 8 else 0) + 0.15 * (1 if 0 < skew <= 1 else 0.6 if 1 < skew <= 2 else 0.3 if 2 < skew <= 4 else 0) + 0.1 * (decay > 0.001)
        out[i] = dict(amplitude=size, rise=rise, slope=slope, half_recovery=fall, decay=decay, skew=skew, snr=snr, prominence=prom[i], quality=score / weight, salience=0.5 * min(1, size / 0.5) + 0.3 * min(1, max(0, slope / 0.5)) + 0.2 * min(1, snr / 3))
    return tonic, p, out


@pytest.mark.parametrize("name,options", [("signal_responses", {}), ("signal_prominent_responses", {"method": "median", "prominent": True})])
def test_response_queries(spark, name, options):
    got = {(r.track, r.idx): r for r in registry.queries()[name](spark, SF).collect()}
    n = 0
    for track, rows in tracks(spark).items():
        tonic, phasic, found = plain_responses([v for *_, v in rows], **options)
        for k, (_, idx, _) in enumerate(rows):
            r = got[track, idx]
            assert (r.tonic, r.phasic) == (pytest.approx(tonic[k], abs=1e-7), pytest.approx(phasic[k], abs=1e-7))
            assert r.peak == (k in found), (track, k)
            for m in signal.MEASURES:
                assert r[m] == (pytest.approx(found[k][m], rel=1e-6, abs=1e-6) if k in found else None), (m, track, k)
            n += k in found
    assert n > 20


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 12), min_size=1, max_size=60), st.integers(1, 9))
def test_apart(values, gap):
    x = np.array(values, float)
    at = np.flatnonzero(x > 3)
    kept = []
    for i in sorted(at.tolist(), key=lambda i: (-x[i], i)):
        if all(abs(i - k) >= gap for k in kept):
            kept.append(i)
    assert sorted(kept) == at[signal.apart(at, x[at], gap)].tolist()


def test_impulses_rebuild():
    k = signal.kernel(10.0)
    driver = np.zeros(300)
    driver[[0, 40, 42, 120, 299]] = [0.2, 1.0, 0.9, 0.5, 0.3]
    at, size = signal.impulses(driver, 10.0)
    assert at.tolist() == [0, 40, 120, 299] and size.tolist() == [0.2, 1.0, 0.5, 0.3]
    want = np.zeros(300)
    for i, s in zip(at, size):
        for j in range(min(k.size, 300 - i)):
            want[i + j] += s * k[j]
    assert np.allclose(signal.rebuilt(at, size, 300, k), want)
    assert signal.noise_sigma(np.random.default_rng(1).normal(size=20_000)) == pytest.approx(1, rel=0.05)


def response(sos, f, fs):
    z = np.exp(-2j * np.pi * f / fs)
    return np.prod([(b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z) for b0, b1, b2, a1, a2 in sos])


def test_filter_designs():
    """The designs' own definitions: equal ripple up to the edge and steep beyond it; flat above the edge, 3 dB at it, nothing at zero."""
    for ripple in (1.0, 0.05):
        sos = spectral.chebyshev(8, ripple, 0.8, 10.0)
        gains = np.abs([response(sos, f, 10.0) for f in np.linspace(0, 0.8, 400)])
        assert gains.max() == pytest.approx(1, abs=1e-6) and gains.min() == pytest.approx(10 ** (-ripple / 20), abs=1e-4)
        assert abs(response(sos, 2.0, 10.0)) < 1e-4
    sos = spectral.highpass(8, 0.01, 2.0)
    assert abs(response(sos, 1.0, 2.0)) == pytest.approx(1) and abs(response(sos, 0.01, 2.0)) == pytest.approx(2**-0.5, rel=1e-6) and abs(response(sos, 1e-9, 2.0)) < 1e-9


def test_zero_phase_sections():
    sos = spectral.chebyshev(8, 0.05, 0.8, 10.0)
    t = np.arange(2000) / 10
    slow, fast = np.sin(2 * np.pi * 0.1 * t), np.sin(2 * np.pi * 3 * t)
    assert np.abs(spectral.both_ways(sos, slow + fast) - slow)[100:-100].max() < 0.02
    assert np.allclose(spectral.both_ways(sos, np.full(100, 4.0)), 4.0 * 10 ** (-0.05 / 10), atol=1e-3)
    plain, y = np.array([1.0, *[0.0] * 60]), None
    y = plain.copy()
    for b0, b1, b2, a1, a2 in sos:
        out, x1, x2, y1, y2 = [], 0.0, 0.0, 0.0, 0.0
        for v in y:
            w = b0 * v + b1 * x1 + b2 * x2 - a1 * y1 - a2 * y2
            x1, x2, y1, y2 = v, x1, w, y1
            out.append(w)
        y = np.array(out)
    assert np.allclose(spectral.sections(sos, plain), y)


def test_sympathetic_power():
    t = np.arange(3000) / 10
    strong, normal = spectral.sympathetic(5 + np.sin(2 * np.pi * 0.15 * t), 10.0)
    weak, _ = spectral.sympathetic(5 + np.sin(2 * np.pi * 0.6 * t), 10.0)
    assert strong == pytest.approx(0.5, rel=0.25) and weak < 0.01 and normal > 0
    assert all(math.isnan(v) for v in spectral.sympathetic(t[:600], 10.0))
    assert spectral.to_rate(np.arange(21.0), 10.0, 2.0).tolist() == [0, 5, 10, 15, 20]
    assert spectral.to_rate(np.arange(10.0), 3.0, 2.0).tolist() == [0, 1.5, 3, 4.5, 6, 7.5, 9]
    at = spectral.at_samples(np.array([1.0, 3.0]), np.array([10.0, 30.0]), np.array([0.0, 1.0, 2.0, 9.0]))
    assert at.tolist() == [10, 10, 20, 30] and spectral.at_samples(np.array([]), np.array([]), np.array([1.0])).tolist() == [0]


def test_bands_query(spark):
    """Whole table, against a plain sum over frequencies of each window."""
    got = defaultdict(list)
    for r in registry.queries()["spectral_bands"](spark, SF).collect():
        got[r.track].append((r.t, r.power))
    for track, rows in list(tracks(spark).items())[:4]:
        t, x = np.array([r[0] for r in rows]), np.array([r[2] for r in rows], float)
        at = t[0] + np.arange(int((t[-1] - t[0]) / 3600) + 1) * 3600
        even = np.interp(at, t, x)
        size = min(64, even.size)
        want = []
        for s in range(0, max(1, even.size - 64 + 1), 5):
            part = even[s : s + 64]
            w = 0.42 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size) + 0.08 * np.cos(4 * np.pi * np.arange(size) / size)
            y = (part - part.mean()) * w
            power = []
            for k in range(size // 2 + 1):
                c = abs(sum(y[n] * np.exp(-2j * np.pi * k * n / size) for n in range(size))) ** 2 / ((w @ w) / 3600)
                power.append(c * (1 if k == 0 or 2 * k == size else 2))
            f = np.arange(size // 2 + 1) / size / 3600
            inside = [i for i in range(f.size) if 0.045 / 3600 <= f[i] <= 0.25 / 3600]
            want.append((at[0] + (s + size / 2) * 3600, sum((f[b] - f[a]) * (power[a] + power[b]) / 2 for a, b in zip(inside, inside[1:]))))
        mine = sorted(got[track])
        assert len(mine) == len(want)
        assert all(a[0] == pytest.approx(b[0]) and a[1] == pytest.approx(b[1], rel=1e-6, abs=1e-9) for a, b in zip(mine, want))


def test_driver_queries(spark):
    """Drivers of every track meet their own conditions of optimality."""
    k = signal.kernel(1.0)
    for name in ("signal_driver", "sparse_driver"):
        got = {(r.track, r.idx): r for r in registry.queries()[name](spark, SF).collect()}
        for track, rows in tracks(spark).items():
            x = np.array([v for *_, v in rows], float)
            d = np.array([got[track, idx].driver for _, idx, _ in rows])
            assert all(got[track, idx].converged for _, idx, _ in rows) and (d >= 0).all()
            rest = np.concatenate((x - x.min() - np.convolve(d, k)[: x.size], np.zeros(k.size - 1)))
            gain = np.array([k @ rest[i : i + k.size] for i in range(x.size)])
            if name == "signal_driver":
                assert gain.max() / (k @ k) < 1.0 + 1e-9
            else:
                inside = np.array([k[: x.size - i] @ rest[i : min(x.size, i + k.size)] for i in range(x.size)])
                assert inside.max() <= 5 + 1e-2 and np.allclose(inside[d > 1e-6], 5, atol=1e-2)


@pytest.mark.parametrize("n", [1, 5, 17, 64, 500])
def test_wavelet_round_trip(n):
    x = np.random.default_rng(n).normal(size=n)
    parts = wavelet.decompose(x, 3)
    assert np.allclose(wavelet.rebuild(parts, n), x, atol=1e-9)
    assert abs(sum(float(p @ p) for p in parts[1:]) + float(parts[0] @ parts[0]) - float((y := wavelet.padded(x)) @ y)) < 1e-6


def test_wavelet_shrinks_noise():
    rng = np.random.default_rng(3)
    t = np.arange(1024) / 100
    clean = np.sin(2 * np.pi * 0.4 * t) * 3
    noisy = clean + rng.normal(size=t.size) * 0.5
    better = wavelet.shrunk(noisy, 5)
    assert np.mean((better - clean) ** 2) < 0.3 * np.mean((noisy - clean) ** 2)
    low = np.array(wavelet.SCALING)
    assert low.sum() == pytest.approx(2**0.5) and low @ low == pytest.approx(1) and all(abs(low[2 * k :] @ low[: 6 - 2 * k]) < 1e-12 for k in (1, 2))


def test_filters_of_many_signals_are_those_of_each():
    """Signals of any lengths step together, to the bit as each by itself; windows together have each one's power."""
    rng = np.random.default_rng(9)
    xs = [rng.normal(size=n) * 50 for n in (1, 2, 3, 5, 30, 31, 200, 200, 333, 1000)]
    low = spectral.chebyshev(8, 1.0, 0.8, 10.0)
    for settled in (False, True):
        got = spectral.sections_of(low, xs, settled)
        assert all(np.array_equal(g, spectral.sections(low, x, float(x[0]) if settled else None)) for g, x in zip(got, xs, strict=True))
    assert all(np.array_equal(g, spectral.both_ways(low, x)) for g, x in zip(spectral.both_ways_of(low, xs), xs, strict=True))
    assert all(np.array_equal(g, spectral.chain(x, 10.0)) for g, x in zip(spectral.chains(xs, 10.0), xs, strict=True))
    power = spectral.band_series(np.array([0.0]), xs[-1], 2.0)[1]
    assert np.allclose(power, [spectral.band_power(*spectral.welch(xs[-1][s : s + 128], 2.0, 128)) for s in range(0, 873, 10)], rtol=1e-9)
    assert sorted(i for places in spectral.shared_out([5, 100, 7, 3], 20) for i in places) == [0, 1, 2, 3] and max(map(len, spectral.shared_out([5, 100, 7, 3], 20))) == 2


@pytest.mark.parametrize("size", [1, 3, 4, 100])
def test_runs_hand_on_whole_tracks(size):
    """Of batches cut anywhere; a track that fills several, a null track and single rows stay whole and in order."""
    import pyarrow as pa

    tracks = [None] * 3 + [1] * 9 + [2] + [3] * 4
    batches = pa.table({"track": pa.array(tracks, pa.int64()), "i": range(len(tracks))}).to_batches(max_chunksize=size)
    calls = []

    def made(parts):
        calls.append([(p.column("track")[0].as_py(), p.num_rows) for p in parts])
        return pa.concat_tables(parts)

    assert [i for b in signal.runs(iter(batches), made, rows=4) for i in b.column("i").to_pylist()] == list(range(len(tracks)))
    assert sum(calls, []) == [(None, 3), (1, 9), (2, 1), (3, 4)] and (len(calls) > 1 or size == 100)


def test_many_tracks_step_together(spark):
    """The series of a table of 40 tracks is that of each by itself, and no track is a group call."""
    from pyspark.sql import functions as F

    from dermotrace.operators.spectral import banded, sympathetic_series

    df = spark.range(40 * 30).select((F.col("id") % 40).alias("track"), (F.floor(F.col("id") / 40) * 5.0 + F.col("id") % 7).alias("t"), F.col("id").alias("idx"), (F.col("id") * 37 % 101).cast("double").alias("value"))
    got = {(r.track, r.idx): r.power for r in sympathetic_series(df, fs=10.0).collect()}
    assert len(got) == 1200
    for track in (0, 7, 39):
        rows = df.where(f"track = {track}").orderBy("t", "idx").collect()
        t, x = np.array([r.t for r in rows]), np.array([r.value for r in rows])
        low = spectral.chain(spectral.resampled(t - t[0], x, 10.0)[1], 10.0)
        assert np.allclose([got[track, r.idx] for r in rows], spectral.at_samples(*spectral.band_series(np.array([0.0]), low, 2.0), t - t[0]))
    plans = [q._jdf.queryExecution().toString() for q in (sympathetic_series(df), banded(df))]
    assert all("MapInArrow" in p and "FlatMapGroupsInArrow" not in p for p in plans)


def test_long_track_is_put_together_a_few_times(monkeypatch):
    """A track of 1000 batches: each row is copied a few times, not once a batch."""
    import pyarrow as pa

    copied, together = [], pa.Table.from_batches
    monkeypatch.setattr(signal, "pa", type("", (), {"Table": type("", (), {"from_batches": staticmethod(lambda kept: (copied.append(sum(b.num_rows for b in kept)), together(kept))[1])})}))
    batches = pa.table({"track": pa.array([1] * 4000 + [2], pa.int64())}).to_batches(max_chunksize=4)
    assert [b.num_rows for b in signal.runs(iter(batches), pa.concat_tables, rows=4)] and sum(copied) < 4 * 4001
