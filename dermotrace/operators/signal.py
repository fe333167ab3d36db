"""Per-track recurrences that frames can't express: zero-phase filters, decomposition, peaks, deconvolution.

Each kernel is plain numpy on whole tracks' samples in time order: rows are dealt and sorted by track, and a task hands on
some whole tracks at a time. A track is a recording by one device, hours long, so what a task holds is bounded by the
recording and not by the number of tracks. Null values are carried forward (back at the start); a track without any value
gives nulls.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..sources.tables import events

#: Smoothing, onset and peak rules of the default detector (seconds, or the signal's unit).
TONIC_S, FLOOR_S, TRIANGLE_S = 45.0, 6.0, 4.0
ONSET_S, GAP_S, SNR, LOW, HIGH = 4.0, 1.3, 2.5, 0.001, 20.0
#: Trailing window of the prominence rule (seconds), rise that ends a recovery, weights of a response's shape.
BASELINE_S, RECOVERY_BREAK = 8.0, 0.1
WEIGHTS = {"amplitude": 0.2, "rise": 0.15, "recovery": 0.15, "skew": 0.15, "slope": 0.1, "snr": 0.15, "decay": 0.1}


def filled(x: np.ndarray) -> np.ndarray:
    good = np.flatnonzero(~np.isnan(x))
    return x if not good.size else x[good[np.clip(np.searchsorted(good, np.arange(x.size), "right") - 1, 0, None)]]


def _ema(x: np.ndarray, alpha: float, seed: float) -> np.ndarray:
    out = np.empty_like(x)
    last = seed
    for i, v in enumerate(x):
        last += alpha * (v - last)
        out[i] = last
    return out


def zero_phase_ema(x: np.ndarray, window: int) -> np.ndarray:
    """Forward and backward, each seeded by the 10th percentile of its first stretch."""
    alpha = 2 / (window + 1)
    seed = lambda part: float(np.sort(part)[int(0.1 * (part.size - 1))])
    n = max(1, round(1 / alpha))
    forward = _ema(x, alpha, seed(x[:n]))
    return _ema(forward[::-1], alpha, seed(forward[-n:]))[::-1]


def butterworth(order: int, cutoff: float, fs: float) -> list[tuple[float, float, float, float, float]]:
    """Low-pass sections (b0, b1, b2, a1, a2) of an even order, by the bilinear transform."""
    k = np.tan(np.pi * cutoff / fs)
    out = []
    for i in range(order // 2):
        q = 1 / (2 * np.sin(np.pi * (2 * i + 1) / (2 * order)))
        norm = 1 / (1 + k / q + k * k)
        out.append((k * k * norm, 2 * k * k * norm, k * k * norm, 2 * (k * k - 1) * norm, (1 - k / q + k * k) * norm))
    return out


def _section(x: np.ndarray, s: tuple[float, float, float, float, float]) -> np.ndarray:
    b0, b1, b2, a1, a2 = s
    gain = (b0 + b1 + b2) / (1 + a1 + a2)
    z2 = (b2 - a2 * gain) * x[0]
    z1 = (b1 - a1 * gain) * x[0] + z2
    out = np.empty_like(x)
    for i, v in enumerate(x):
        y = b0 * v + z1
        z1, z2 = b1 * v - a1 * y + z2, b2 * v - a2 * y
        out[i] = y
    return out


def zero_phase_lowpass(x: np.ndarray, cutoff: float, fs: float, order: int = 4) -> np.ndarray:
    """Butterworth forward and backward on an oddly reflected signal; short or unfilterable signals pass."""
    pad = 3 * (order + 1)
    if x.size <= pad or cutoff >= fs / 2:
        return x.copy()
    y = np.concatenate((2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]))
    for s in butterworth(order, cutoff, fs):
        y = _section(y, s)
    y = y[::-1]
    for s in butterworth(order, cutoff, fs):
        y = _section(y, s)
    return y[::-1][pad:-pad]


def moving_average(x: np.ndarray, width: float) -> np.ndarray:
    """Two centred boxes of half the width, so that the whole is a triangle; the ends of a box count by its fraction, edges by what exists."""
    if not width > 1 or not x.size:
        return x.copy()
    reach = ((width + 1) / 2 - 1) / 2
    whole = int(reach)
    box = np.concatenate(([reach - whole], np.ones(2 * whole + 1), [reach - whole]))
    weight = np.convolve(np.ones(x.size), box)[whole + 1 : whole + 1 + x.size]
    for _ in (0, 1):
        x = np.convolve(x, box)[whole + 1 : whole + 1 + x.size] / weight
    return x


def linkwitz_riley(x: np.ndarray, cutoff: float, fs: float) -> np.ndarray:
    """Two zero-phase passes of second order: steep, without ringing."""
    return zero_phase_lowpass(zero_phase_lowpass(x, cutoff, fs, 2), cutoff, fs, 2)


def ranked(x: np.ndarray, width: int, share: float) -> np.ndarray:
    """Rolling element floor(n * share) of the sorted values of a centred frame, cut at the ends."""
    half = width // 2
    out = np.empty(x.size)
    if x.size > 2 * half:
        frames = np.lib.stride_tricks.sliding_window_view(x, 2 * half + 1)
        k = min(2 * half, int((2 * half + 1) * share))
        for at in range(0, len(frames), 1 << 14):
            part = frames[at : at + (1 << 14)]
            out[half + at : half + at + len(part)] = np.partition(part, k, axis=1)[:, k]
    for i in [*range(min(half, x.size)), *range(max(half, x.size - half), x.size)] if x.size > 2 * half else range(x.size):
        part = np.sort(x[max(0, i - half) : i + half + 1])
        out[i] = part[min(part.size - 1, int(part.size * share))]
    return out


def decompose(x: np.ndarray, fs: float, method: str = "lpf", seconds: float = TONIC_S) -> tuple[np.ndarray, np.ndarray]:
    """(tonic, phasic): slow level (smoothed, ``median`` or ``percentile``), put under the signal by its smoothed running minimum; the positive rest."""
    width = max(5, round(seconds * fs))
    tonic = ranked(x, width, 0.5) if method == "median" else ranked(x, width, 0.1) if method == "percentile" else zero_phase_ema(x, width)
    half = max(1, round(FLOOR_S * fs))
    padded = np.pad(x - tonic, half, constant_values=np.inf)
    low = np.lib.stride_tricks.sliding_window_view(padded, 2 * half + 1).min(axis=1)
    tonic = tonic + moving_average(low, 2 * round(TRIANGLE_S * fs) - 1)
    return tonic, np.maximum(0.0, x - tonic)


def prominence(x: np.ndarray) -> np.ndarray:
    """Height of each local maximum over the higher of the lowest points towards higher ground; zero elsewhere."""
    out = np.zeros(x.size)
    stack: list[tuple[float, float]] = []  # heights still open to the right, with the low since the one before
    left = np.empty(x.size)
    for direction in (1, -1):
        y, low_since = x[::direction], np.empty(x.size)
        stack = []
        for i, v in enumerate(y):
            low = v
            while stack and stack[-1][0] <= v:
                low = min(low, stack.pop()[1])
            low_since[i] = low if not stack else low
            stack.append((v, low))
        if direction == 1:
            left = low_since
        else:
            right = low_since[::-1]
    peak = np.zeros(x.size, bool)
    if x.size > 2:
        peak[1:-1] = (x[1:-1] > x[:-2]) & (x[1:-1] >= x[2:])
    out[peak] = x[peak] - np.maximum(left, right)[peak]
    return out


def noise(x: np.ndarray, half: int) -> np.ndarray:
    """At each sample the deviation of steps within ``half`` samples over the root of two, 1e-6 at least."""
    d = np.diff(x, prepend=x[:1]) - (np.diff(x).mean() if x.size > 1 else 0.0)
    sums, squares = np.append(0, np.cumsum(d)), np.append(0, np.cumsum(d * d))
    at = np.arange(x.size)
    low, high = np.maximum(1, at - half), np.minimum(x.size - 1, at + half) + 1
    n = high - low
    some = np.maximum(n, 1)
    mean = (sums[high] - sums[low]) / some
    spread = np.sqrt(np.maximum(0, (squares[high] - squares[low]) / some - mean * mean)) / 2**0.5
    return np.where(n < 2, 1e-6, np.maximum(1e-6, spread))


def summits(x: np.ndarray) -> np.ndarray:
    """Places above the sample before and not below the one after."""
    return np.flatnonzero((x[1:-1] > x[:-2]) & (x[1:-1] >= x[2:])) + 1 if x.size > 2 else np.empty(0, np.int64)


def onsets(x: np.ndarray, at: np.ndarray, steps: int) -> np.ndarray:
    """The first trough before each place: where the signal turned up, was not above zero, or ``steps`` before."""
    turn = x <= 0
    turn[1:] |= x[1:] < x[:-1]
    turn[:1] = True
    last = np.maximum.accumulate(np.where(turn, np.arange(x.size), -1))
    return np.where(x[at] <= 0, at, np.maximum(last[np.maximum(at - 1, 0)], np.maximum(at - steps, 0)))


def deep_onset(x: np.ndarray, at: int, steps: int, dip: float) -> int:
    """The lowest sample before a place, up to where the signal has risen by ``dip`` over it again."""
    low = i = at
    while i > 0 and x[i] > 0 and at - i < steps and not (i < at and x[i] >= x[low] + dip):
        i -= 1
        low = i if x[i] < x[low] else low
    return low


def recovery(x: np.ndarray, at: int, onset: int) -> int:
    """The first later sample at half the height or lower; -1 if the signal rises again before, well above it, or ends."""
    half = x[onset] + (x[at] - x[onset]) * 0.5
    for start in range(at + 1, x.size, 256):
        part, after = x[start : start + 256], x[start + 1 : start + 257]
        down = np.flatnonzero(part <= half)
        up = np.flatnonzero((part[: after.size] < after) & (part[: after.size] > half + RECOVERY_BREAK))
        if down.size and (not up.size or down[0] <= up[0]):
            return start + int(down[0])
        if up.size:
            return -1
    return -1


def apart(at: np.ndarray, size: np.ndarray, gap: int) -> np.ndarray:
    """Which places stay if the largest comes first (of equal ones the earliest) and no other is nearer than ``gap``."""
    keep, taken = np.zeros(at.size, bool), {}  # a cell of the gap's size holds one place at most
    for i in np.lexsort((at, -size)).tolist():
        place = int(at[i])
        cell = place // gap
        if all(abs(taken.get(c, place + gap) - place) >= gap for c in (cell - 1, cell, cell + 1)):
            keep[i], taken[cell] = True, place
    return keep


def peaks(phasic: np.ndarray, signal: np.ndarray, fs: float, threshold: float, high: float = HIGH, snr: float = SNR, t: np.ndarray | None = None, by_prominence: bool = False, quality: float = 0.0) -> dict[str, np.ndarray]:
    """Responses by column: place, onset, recovery (or -1), amplitude, rise, slopes, skew, noise ratio, prominence, quality, salience.

    A response is a summit that rose by the threshold from the trough before it, over noise (or that is as prominent as the
    threshold); of those within ``GAP_S`` the one that rose most (is most prominent) stays.
    """
    steps, gap, wide = round(ONSET_S * fs), max(1, round(GAP_S * fs)), max(1, round(fs))
    t = np.arange(phasic.size) / fs if t is None else t
    at, prom, floor = summits(phasic), prominence(phasic), noise(signal, wide)
    at = at[(phasic[at] >= LOW) & (phasic[at] <= high)]
    if by_prominence:
        back = max(1, round(BASELINE_S * fs))
        before = np.lib.stride_tricks.sliding_window_view(np.pad(phasic, (back, 0), constant_values=np.inf), back + 1).min(axis=1)
        at = at[(prom[at] >= threshold) & (phasic[at] - before[at] <= high)]
        at = at[apart(at, prom[at], gap)]
        on = np.array([deep_onset(phasic, i, steps, threshold) for i in at.tolist()], np.int64)
    else:
        on = onsets(phasic, at, steps)
        size = phasic[at] - phasic[on]
        good = (size >= threshold) & ((snr <= 0) | (size / floor[on] >= snr))
        at, on, size = at[good], on[good], size[good]
        kept = apart(at, size, gap)
        at, on = at[kept], on[kept]
    back = np.array([recovery(phasic, i, j) for i, j in zip(at.tolist(), on.tolist(), strict=True)], np.int64)
    amplitude, rise = phasic[at] - phasic[on], t[at] - t[on]
    fall = np.where(back >= 0, t[back] - t[at], -1.0)
    over = lambda a, b: np.divide(a, b, out=np.zeros(a.size), where=b > 0)
    out = {"place": at, "onset": on, "recovery": back, "amplitude": amplitude, "rise": rise, "slope": over(amplitude, rise), "half_recovery": fall, "decay": over(phasic[at] - phasic[back], fall), "skew": over(rise, fall), "snr": amplitude / floor[on], "prominence": prom[at]}
    out |= {"quality": shape_quality(out), "salience": salience(out)}
    stay = out["quality"] >= quality
    return {k: v[stay] for k, v in out.items()}


def _graded(x: np.ndarray, steps: tuple[tuple[float, float, float], ...]) -> np.ndarray:
    """The worth of the first range (low, high, worth) that holds each value, else 0."""
    return np.select([(x >= a) & (x <= b) for a, b, _ in steps], [w for *_, w in steps], 0.0)


def shape_quality(p: dict[str, np.ndarray]) -> np.ndarray:
    """0 to 1: the earned share of the weights that apply; what needs a recovery is left out without one."""
    inf, w = np.inf, WEIGHTS
    one = np.ones(p["amplitude"].size)
    fell, skew, snr = p["half_recovery"] > 0, p["skew"], p["snr"]
    terms = (
        (w["amplitude"], one, np.minimum(1, p["amplitude"] / 0.5)),
        (w["rise"], p["rise"] > 0, _graded(p["rise"], ((0.5, 3.0, 1.0), (-inf, 5.0, 0.5)))),
        (w["slope"], p["slope"] > 0, _graded(p["slope"], ((0.01, 1.0, 1.0), (-inf, 3.0, 0.5)))),
        (w["snr"], one, _graded(snr, ((3.0, inf, 1.0), (2.0, inf, 0.7), (1.5, inf, 0.4)))),
        (w["recovery"], fell, _graded(p["half_recovery"], ((0.5, 4.0, 1.0), (-inf, 8.0, 0.5)))),
        (w["skew"], fell, np.where(skew > 0, _graded(skew, ((0, 1.0, 1.0), (1.0, 2.0, 0.6), (2.0, 4.0, 0.3))), 0.0)),
        (w["decay"], fell, (p["decay"] > 0.001) * 1.0),
    )
    earned = sum(weight * applies * worth for weight, applies, worth in terms)
    return np.clip(earned / sum(weight * applies for weight, applies, _ in terms), 0, 1)


def kernel_quality(p: dict[str, np.ndarray]) -> np.ndarray:
    """0 to 1 where the shape is the kernel's own: from amplitude and noise alone, weighted as above."""
    a, b = WEIGHTS["amplitude"], WEIGHTS["snr"]
    return np.clip((a * np.minimum(1, p["amplitude"] / 0.5) + b * _graded(p["snr"], ((3.0, np.inf, 1.0), (2.0, np.inf, 0.7), (1.5, np.inf, 0.4)))) / (a + b), 0, 1)


def salience(p: dict[str, np.ndarray]) -> np.ndarray:
    """0 to 1: half by amplitude, then by slope and noise ratio."""
    part = lambda c, top: np.clip(p[c] / top, 0, 1)
    return 0.5 * part("amplitude", 0.5) + 0.3 * part("slope", 0.5) + 0.2 * part("snr", 3.0)


def impulses(driver: np.ndarray, fs: float, threshold: float = 0.005, gap_s: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """(place, size) of a driver's maxima over the threshold; of those within the gap the largest."""
    edge = np.pad(driver, 1, constant_values=-np.inf)
    at = np.flatnonzero((driver > threshold) & (driver >= edge[:-2]) & (driver >= edge[2:]))
    at = at[apart(at, driver[at], max(1, round(gap_s * fs)))]
    return at, driver[at]


def rebuilt(at: np.ndarray, size: np.ndarray, n: int, k: np.ndarray) -> np.ndarray:
    """The signal of impulses: kernels added up, cut at the end."""
    driver = np.zeros(n)
    np.add.at(driver, at, size)
    return np.convolve(driver, k)[:n]


def noise_sigma(x: np.ndarray) -> float:
    """From the median size of steps."""
    d = np.sort(np.abs(np.diff(x)))
    return 1.4826 * float(d[d.size // 2]) / 2**0.5 if d.size else 0.0


def kernel(fs: float, rise: float = 0.75, decay: float = 2.0, seconds: float = 10.0) -> np.ndarray:
    """Difference of two exponentials, scaled to a peak of one."""
    t = np.arange(round(seconds * fs) + 1) / fs
    k = np.exp(-t / decay) - np.exp(-t / rise)
    return k / (k.max() or 1)


def pursued(x: np.ndarray, k: np.ndarray, least: float, most: int | None = None) -> tuple[np.ndarray, bool]:
    """Driver by matching pursuit, and whether it converged: the atom that explains most is taken until its size is under ``least``.

    Each atom takes least^2 |k|^2 of energy or more, so a finite signal ends. An atom changes the gains within a kernel's
    length only, and the largest gain is found over the maxima of blocks.
    """
    if not least > 0 or not np.isfinite(x).all():
        return np.zeros(x.size), False
    n, m, block, energy = x.size, k.size, 1024, float(k @ k) or 1.0
    rest, driver = np.concatenate((x.astype(float), np.zeros(m - 1))), np.zeros(n)
    gain = np.full(-(-n // block) * block, -np.inf)
    gain[:n] = np.correlate(rest, k, "valid") / energy
    top = gain.reshape(-1, block).max(axis=1)
    taken = 0
    while top.size:
        b = int(np.argmax(top))
        at = b * block + int(np.argmax(gain[b * block : (b + 1) * block]))
        if gain[at] < least:
            break
        if taken == most:
            return driver, False
        taken += 1
        driver[at] += gain[at]
        end = min(n, at + m)
        rest[at:end] -= gain[at] * k[: end - at]
        low = max(0, at - m + 1)
        gain[low:end] = np.correlate(rest[low : end + m - 1], k, "valid") / energy
        for c in range(low // block, (end - 1) // block + 1):
            top[c] = gain[c * block : (c + 1) * block].max()
    return driver, True


def pursue(x: np.ndarray, k: np.ndarray, least: float, most: int | None = None) -> np.ndarray:
    return pursued(x, k, least, most)[0]


#: Rows that a task gathers before whole tracks go to a kernel.
GATHERED = 16384

Track = tuple[np.ndarray, np.ndarray]


def runs(batches: Iterator[pa.RecordBatch], made: Callable[[list[pa.Table]], pa.Table], key: str = "track", rows: int = GATHERED) -> Iterator[pa.RecordBatch]:
    """``made`` of the whole tracks in turn, some at a time, of batches in the tracks' order; the last track waits for its end."""
    kept: list[pa.RecordBatch] = []
    wait = rows

    def split(last: bool) -> list[pa.Table]:
        table = pa.Table.from_batches(kept).combine_chunks()
        codes = table.column(key).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), table.num_rows]
        parts = [table.slice(a, b - a) for a, b in itertools.pairwise(edges)]
        kept[:] = [] if last else parts.pop().to_batches()
        return parts

    for batch in batches:
        if batch.num_rows:
            kept.append(batch)
            if sum(b.num_rows for b in kept) >= wait:
                parts = split(False)
                wait = max(rows, 2 * sum(b.num_rows for b in kept))  # a long track is put together again when it has doubled
                if parts:
                    yield from made(parts).to_batches()
    if kept:
        yield from made(split(True)).to_batches()


def in_tracks(df: DataFrame, made: Callable[[list[pa.Table]], pa.Table], schema: T.StructType | str, order: tuple[str, ...] = ("t", "idx"), rows: int = GATHERED) -> DataFrame:
    """``made`` of lists of whole tracks, each in order: one shuffle and one sort, no group call a track.

    The number of partitions is fixed: kernels cost far more than their rows' size tells, by which Spark would join partitions.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, "track").sortWithinPartitions("track", *order).mapInArrow(lambda batches: runs(batches, made, rows=rows), schema)


def per_tracks(df: DataFrame, column: str, out: dict[str, str], kernel_: Callable[[list[Track]], list[dict[str, np.ndarray]]]) -> DataFrame:
    """(track, t, idx) with the columns that the kernel makes from some tracks' (times, values) in time order."""
    schema = T.StructType([*(df.schema[c] for c in ("track", "t", "idx")), *(T.StructField(k, T.DoubleType() if v == "double" else T.BooleanType()) for k, v in out.items())])
    kinds = {"double": pa.float64(), "boolean": pa.bool_()}

    def run(tracks: list[pa.Table]) -> pa.Table:
        series = [(part.column("t").to_numpy().astype(float), filled(part.column(column).to_numpy().astype(float))) for part in tracks]
        some = [i for i, (_, x) in enumerate(series) if not np.isnan(x).all()]
        found = dict(zip(some, kernel_([series[i] for i in some]), strict=True))
        columns = [pa.chunked_array([pa.array(found[i][k], kinds[v], from_pandas=True) if i in found and k in found[i] else pa.nulls(x.size, kinds[v]) for i, (_, x) in enumerate(series)]).combine_chunks() for k, v in out.items()]
        table = pa.concat_tables(tracks)
        return pa.table([*(table.column(c).combine_chunks() for c in ("track", "t", "idx")), *columns], names=["track", "t", "idx", *out])

    return in_tracks(df.select("track", "t", "idx", column), run, schema)


def per_track(df: DataFrame, column: str, out: dict[str, str], kernel_: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]]) -> DataFrame:
    """(track, t, idx) with the columns that the kernel makes from (times, values) of each track in time order."""
    return per_tracks(df, column, out, lambda tracks: [kernel_(t, x) for t, x in tracks])


def smoothed(df: DataFrame, column: str = "value", window: int = 9) -> DataFrame:
    return per_track(df, column, {"smooth": "double"}, lambda t, x: {"smooth": zero_phase_ema(x, window)})


def lowpassed(df: DataFrame, column: str = "value", cutoff: float = 0.1, fs: float = 1.0) -> DataFrame:
    return per_track(df, column, {"low": "double"}, lambda t, x: {"low": zero_phase_lowpass(x, cutoff, fs)})


MEASURES = ("amplitude", "rise", "slope", "half_recovery", "decay", "skew", "snr", "prominence", "quality", "salience")


def detected(df: DataFrame, column: str = "value", fs: float = 1.0, threshold: float = 0.045, high: float = HIGH, method: str = "lpf", by_prominence: bool = False, seconds: float = TONIC_S) -> DataFrame:
    """tonic, phasic and peak of each sample, and at peaks the measures of the response."""

    def run(t, x):
        tonic, phasic = decompose(x, fs, method, seconds)
        found = peaks(phasic, x, fs, threshold, high, by_prominence=by_prominence)
        out = {"tonic": tonic, "phasic": phasic, "peak": np.zeros(x.size, bool)}
        out["peak"][found["place"]] = True
        for m in MEASURES:
            out[m] = np.full(x.size, np.nan)
            out[m][found["place"]] = found[m]
        return out

    return per_track(df, column, {"tonic": "double", "phasic": "double", "peak": "boolean", **dict.fromkeys(MEASURES, "double")}, run)


def driver_impulses(df: DataFrame, column: str = "driver", fs: float = 1.0) -> DataFrame:
    """``impulse`` of each sample of a driver series: the size of the impulse there, or 0."""

    def run(t, x):
        out = np.zeros(x.size)
        at, size = impulses(x, fs)
        out[at] = size
        return {"impulse": out}

    return per_track(df, column, {"impulse": "double"}, run)


def prominent(df: DataFrame, column: str = "value") -> DataFrame:
    return per_track(df, column, {"prominence": "double"}, lambda t, x: {"prominence": prominence(x)})


def driven(df: DataFrame, column: str = "value", fs: float = 1.0, least: float = 1.0) -> DataFrame:
    k = kernel(fs)

    def run(t, x):
        driver, converged = pursued(x - x.min(), k, least)
        return {"driver": driver, "converged": np.full(x.size, converged)}

    return per_track(df, column, {"driver": "double", "converged": "boolean"}, run)


QUERIES = {
    "signal_smooth": lambda s, d: smoothed(events(s, d)),
    "signal_lowpass": lambda s, d: lowpassed(events(s, d)),
    "signal_responses": lambda s, d: detected(events(s, d), threshold=5.0, high=1e9),
    "signal_prominent_responses": lambda s, d: detected(events(s, d), threshold=5.0, high=1e9, method="median", by_prominence=True),
    "signal_gait": lambda s, d: per_track(events(s, d), "value", {"low": "double"}, lambda t, x: {"low": linkwitz_riley(x, 0.1, 1.0)}),
    "signal_impulses": lambda s, d: driver_impulses(driven(events(s, d))),
    "signal_prominence": lambda s, d: prominent(events(s, d)),
    "signal_driver": lambda s, d: driven(events(s, d)),
}
ORACLE_SQL: dict[str, str] = {}
