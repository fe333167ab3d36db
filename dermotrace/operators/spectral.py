"""Spectral and sparse kernels of a track: band power in hops, Welch density, non-negative sparse driver, resampling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import events
from .signal import filled, in_tracks, kernel, per_tracks

#: Window and hop in seconds, and the band (Hz) of sympathetic activity.
WINDOW_S, HOP_S, BAND = 64.0, 5.0, (0.045, 0.25)
#: Windows transformed together; samples that are filtered together, and the fewest tracks worth it.
BLOCK, FILTERED, TOGETHER = 4096, 1 << 21, 8
#: Rounds after which the sparse driver of a track counts as not converged.
ROUNDS = 20000


def blackman(n: int) -> np.ndarray:
    """Periodic."""
    k = 2 * np.pi * np.arange(n) / n
    return 0.42 - 0.5 * np.cos(k) + 0.08 * np.cos(2 * k)


def welch(x: np.ndarray, fs: float, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(frequencies, one-sided density): half-overlapping windows with their mean taken off."""
    size = min(size, x.size)
    w = blackman(size)
    parts = np.lib.stride_tricks.sliding_window_view(x, size)[:: max(1, size // 2)]
    p = (np.abs(np.fft.rfft((parts - parts.mean(axis=1, keepdims=True)) * w, axis=1)) ** 2).mean(axis=0) / (fs * (w @ w))
    p[1 : (size + 1) // 2] *= 2
    return np.fft.rfftfreq(size, 1 / fs), p


def band_power(f: np.ndarray, p: np.ndarray, band: tuple[float, float] = BAND) -> float:
    """Trapezoids within the band."""
    inside = (f >= band[0]) & (f <= band[1])
    return float(np.trapezoid(p[inside], f[inside])) if inside.sum() > 1 else 0.0


def resampled(t: np.ndarray, x: np.ndarray, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """Linear, at an even rate from the first time on."""
    at = t[0] + np.arange(int((t[-1] - t[0]) * fs) + 1) / fs
    return at, np.interp(at, t, x)


def window_powers(parts: np.ndarray, fs: float, band: tuple[float, float] = BAND) -> np.ndarray:
    """Band power of each row, a window: that of its Welch density, all rows transformed together."""
    size = parts.shape[1]
    w, f = blackman(size), np.fft.rfftfreq(size, 1 / fs)
    inside = (f >= band[0]) & (f <= band[1])
    if inside.sum() < 2:
        return np.zeros(len(parts))
    p = np.abs(np.fft.rfft((parts - parts.mean(axis=1, keepdims=True)) * w, axis=1)) ** 2 / (fs * (w @ w))
    p[:, 1 : (size + 1) // 2] *= 2
    return np.trapezoid(p[:, inside], f[inside], axis=1)


def band_series(t: np.ndarray, x: np.ndarray, fs: float, window_s: float = WINDOW_S, hop_s: float = HOP_S, band: tuple[float, float] = BAND) -> tuple[np.ndarray, np.ndarray]:
    """(centre, band power) of each hop; the whole signal where it is shorter than a window."""
    size, hop = round(window_s * fs), max(1, round(hop_s * fs))
    own = min(size, x.size)
    windows = np.lib.stride_tricks.sliding_window_view(x, own)[::hop]
    power = np.concatenate([window_powers(windows[i : i + BLOCK], fs, band) for i in range(0, len(windows), BLOCK)])
    return t[0] + (np.arange(len(windows)) * hop + own / 2) / fs, power


Sections = list[tuple[float, float, float, float, float]]


def _digital(poles: np.ndarray, zero: float, fs: float) -> Sections:
    """Second-order sections of analogue poles (the first half of conjugate pairs) by the bilinear transform, with double zeros at ``zero``."""
    z = (2 * fs + poles) / (2 * fs - poles)
    return [(1.0, -2 * zero, zero * zero, -2 * p.real, abs(p) ** 2) for p in z]


def _scaled(sos: Sections, at: float, target: float) -> Sections:
    """With the gain ``target`` at z = ``at``."""
    gain = np.prod([(b0 + b1 * at + b2) / (1 + a1 * at + a2) for b0, b1, b2, a1, a2 in sos])
    (b0, b1, b2, a1, a2), *rest = sos
    g = target / gain
    return [(b0 * g, b1 * g, b2 * g, a1, a2), *rest]


def chebyshev(order: int, ripple_db: float, cutoff: float, fs: float) -> Sections:
    """Low-pass of an even order with equal ripple up to the edge."""
    k = np.arange(order // 2)
    theta, mu = np.pi * (2 * k + 1) / (2 * order), np.arcsinh(1 / np.sqrt(10 ** (ripple_db / 10) - 1)) / order
    poles = (-np.sinh(mu) * np.sin(theta) + 1j * np.cosh(mu) * np.cos(theta)) * 2 * fs * np.tan(np.pi * cutoff / fs)
    return _scaled(_digital(poles, -1.0, fs), 1.0, 10 ** (-ripple_db / 20))


def highpass(order: int, cutoff: float, fs: float) -> Sections:
    """Butterworth of an even order."""
    theta = np.pi * (2 * np.arange(order // 2) + 1) / (2 * order)
    poles = 2 * fs * np.tan(np.pi * cutoff / fs) / (-np.sin(theta) + 1j * np.cos(theta))
    return _scaled(_digital(poles, 1.0, fs), -1.0, 1.0)


def sections(sos: Sections, x: np.ndarray, settled: float | None = None) -> np.ndarray:
    """Filtered forward, from rest or from a state that has settled at a constant."""
    level = settled
    for b0, b1, b2, a1, a2 in sos:
        z1 = z2 = 0.0
        if level is not None:
            gain = (b0 + b1 + b2) / (1 + a1 + a2)
            z2 = (b2 - a2 * gain) * level
            z1 = (b1 - a1 * gain) * level + z2
            level *= gain
        out = []
        for v in x.tolist():
            y = b0 * v + z1
            z1, z2 = b1 * v - a1 * y + z2, b2 * v - a2 * y
            out.append(y)
        x = np.array(out)
    return x


def sections_of(sos: Sections, xs: list[np.ndarray], settled: bool = False) -> list[np.ndarray]:
    """``sections`` of each signal, to the bit, from rest or settled at its first sample: all step together, the sections one sample apart."""
    if len(xs) < TOGETHER:
        return [sections(sos, x, float(x[0]) if settled else None) for x in xs]
    n, s, m = max(x.size for x in xs), len(sos), len(xs)
    rows = np.zeros((n + s - 1, m))
    for i, x in enumerate(xs):
        rows[: x.size, i] = x
    b0, b1, b2, a1, a2 = (np.repeat(np.array(c)[:, None], m, axis=1) for c in zip(*sos, strict=True))  # whole: broadcasting costs more than the sums
    z1, z2, v, y, part = (np.zeros((s, m)) for _ in range(5))  # v: what each section takes
    if settled:
        level = rows[0].copy()
        for j, (c0, c1, c2, d1, d2) in enumerate(sos):
            gain = (c0 + c1 + c2) / (1 + d1 + d2)
            z2[j] = (c2 - d2 * gain) * level
            z1[j] = (c1 - d1 * gain) * level + z2[j]
            level *= gain
    begun = [z1.copy(), z2.copy()]
    for i in range(n + s - 1):
        v[0] = rows[i]
        np.multiply(b0, v, out=y)
        y += z1
        np.multiply(b1, v, out=z1)
        np.multiply(a1, y, out=part)
        z1 -= part
        z1 += z2
        np.multiply(b2, v, out=z2)
        np.multiply(a2, y, out=part)
        z2 -= part
        if i < s - 1:  # a section begins when its first sample arrives
            z1[i + 1 :], z2[i + 1 :] = begun[0][i + 1 :], begun[1][i + 1 :]
        else:
            rows[i - s + 1] = y[-1]
        v[1:] = y[:-1]
    return [rows[: x.size, i].copy() for i, x in enumerate(xs)]


def both_ways_of(sos: Sections, xs: list[np.ndarray]) -> list[np.ndarray]:
    """``both_ways`` of each signal."""
    edges = [min(3 * (2 * len(sos) + 1), x.size - 1) for x in xs]
    some = [i for i, e in enumerate(edges) if e >= 1]
    ys = [np.concatenate((2 * x[0] - x[e:0:-1], x, 2 * x[-1] - x[-2 : -e - 2 : -1])) for x, e in ((xs[i], edges[i]) for i in some)]
    for _ in (0, 1):
        ys = [y[::-1] for y in sections_of(sos, ys, True)]
    out = [x.copy() for x in xs]
    for i, y in zip(some, ys, strict=True):
        out[i] = y[edges[i] : -edges[i]]
    return out


def both_ways(sos: Sections, x: np.ndarray) -> np.ndarray:
    """Zero phase: forward and back over an oddly reflected signal; a short one is reflected as far as it goes."""
    edge = min(3 * (2 * len(sos) + 1), x.size - 1)
    if edge < 1:
        return x.copy()
    y = np.concatenate((2 * x[0] - x[edge:0:-1], x, 2 * x[-1] - x[-2 : -edge - 2 : -1]))
    for _ in (0, 1):
        y = sections(sos, y, float(y[0]))[::-1]
    return y[edge:-edge]


def to_rate(x: np.ndarray, fs: float, rate: float) -> np.ndarray:
    """Samples at a lower rate, on the line between two where they don't meet one."""
    ratio = fs / rate
    if ratio <= 1 or not x.size:
        return x.copy()
    return np.interp(np.arange(int((x.size - 1) / ratio) + 1) * ratio, np.arange(x.size), x)


def chains(xs: list[np.ndarray], fs: float) -> list[np.ndarray]:
    """The band's own signal at 2 Hz of each: two low-passes at 0.8 Hz (forward, then zero phase), then a zero-phase high-pass at 0.01 Hz."""
    some = [i for i, x in enumerate(xs) if x.size >= 2]
    low = both_ways_of(chebyshev(8, 0.05, 0.8, fs), sections_of(chebyshev(8, 1.0, 0.8, fs), [xs[i] for i in some]))
    out = [x[:0] for x in xs]
    for i, y in zip(some, both_ways_of(highpass(8, 0.01, 2.0), [to_rate(y, fs, 2.0) for y in low]), strict=True):
        out[i] = y
    return out


def chain(x: np.ndarray, fs: float) -> np.ndarray:
    return chains([x], fs)[0]


def sympathetic(x: np.ndarray, fs: float) -> tuple[float, float]:
    """(band power, band power over the largest density) of a whole signal; NaN up to a window's length."""
    if x.size <= fs * WINDOW_S:
        return float("nan"), float("nan")
    f, p = welch(chain(x, fs), 2.0, round(2 * WINDOW_S))
    top = float(p.max())
    return band_power(f, p), band_power(f, p / top) if top > 0 else float("nan")


def at_samples(centre: np.ndarray, power: np.ndarray, t: np.ndarray) -> np.ndarray:
    """A series of windows at each sample's time: on the line between two, held beyond the ends; zeros without a window."""
    return np.interp(t, centre, power) if centre.size else np.zeros(t.size)


def sparse_solved(x: np.ndarray, k: np.ndarray, penalty: float, rounds: int = 60, begun: tuple[int, np.ndarray, np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, bool]:
    """Non-negative lasso by coordinate descent, and whether it converged: d minimises |x - k * d|^2 / 2 + penalty * sum(d).

    ``begun``: rounds done, and the driver, rest and active places after them.
    """
    n, energy = x.size, np.array([float(k[: x.size - i] @ k[: x.size - i]) for i in range(x.size)])
    first, driver, rest, active = begun or (0, np.zeros(n), x.astype(float).copy(), np.arange(n))
    for r in range(first, rounds):
        most = 0.0
        for i in active:
            part = k[: n - i]
            new = max(0.0, driver[i] + (part @ rest[i : i + part.size] - penalty) / (energy[i] or 1.0)) if energy[i] else 0.0
            if step := new - driver[i]:
                rest[i : i + part.size] -= step * part
                driver[i] = new
                most = max(most, abs(step))
        if most < 1e-6:
            if active.size == n:
                return driver, True
            active = np.arange(n)
        else:
            active = np.flatnonzero(driver) if r % 5 and driver.any() else np.arange(n)
    return driver, not n


def sparse_solved_of(xs: list[np.ndarray], k: np.ndarray, penalty: float, rounds: int = 60) -> list[tuple[np.ndarray, bool]]:
    """``sparse_solved`` of each signal: all take the same place of a round together, and leave when they have converged.

    Signals end on the same row, so that a kernel is cut at the same place of all.
    """
    out: list[tuple[np.ndarray, bool]] = [(np.empty(0), True)] * len(xs)
    left = np.array([i for i, x in enumerate(xs) if x.size and np.isfinite(x).all()], np.int64)
    for i in set(range(len(xs))) - set(left.tolist()):
        out[i] = sparse_solved(xs[i], k, penalty, rounds)
    n = max((xs[i].size for i in left), default=0)
    start = np.array([n - xs[i].size for i in left], np.int64)
    energy = [float(k[: n - i] @ k[: n - i]) for i in range(n)]
    rest, driver = np.zeros((n, left.size)), np.zeros((n, left.size))
    for c, i in enumerate(left):
        rest[start[c] :, c] = xs[i]
    own = np.arange(n)[:, None] >= start
    active, r = own, 0
    while left.size >= TOGETHER and r < rounds:
        most = np.zeros(left.size)
        for i in np.flatnonzero(active.any(axis=1)).tolist():
            part, was = k[: n - i], driver[i]
            new = np.fmax(0.0, was + (part @ rest[i : i + part.size] - penalty) / energy[i]) if energy[i] else np.zeros(left.size)
            new = np.where(active[i], new, was)
            step = new - was
            if step.any():
                rest[i : i + part.size] -= part[:, None] * step
                driver[i] = new
                most = np.maximum(most, np.abs(step))
        settled, some = most < 1e-6, driver > 0
        done = settled & (active == own).all(axis=0)
        active = np.where(~settled & some.any(axis=0), some, own) if r % 5 else own
        r += 1
        if done.any():
            for c in np.flatnonzero(done):
                out[left[c]] = driver[start[c] :, c].copy(), True
            left, start = left[~done], start[~done]
            rest, driver, own, active = (np.ascontiguousarray(m[:, ~done]) for m in (rest, driver, own, active))
    for c, i in enumerate(left):
        begun = r, *(m[start[c] :, c].copy() for m in (driver, rest)), np.flatnonzero(active[start[c] :, c])
        out[i] = sparse_solved(xs[i], k, penalty, rounds, begun)
    return out


def sparse_driver(x: np.ndarray, k: np.ndarray, penalty: float, rounds: int = 60) -> np.ndarray:
    return sparse_solved(x, k, penalty, rounds)[0]


def banded(df: DataFrame, column: str = "value", fs: float = 1 / 3600, window_s: float = 64 * 3600.0, hop_s: float = 5 * 3600.0, band: tuple[float, float] = (0.045 / 3600, 0.25 / 3600)) -> DataFrame:
    """(track, t, power): band power in hops, a track's windows transformed together; bounded by a recording's length."""

    def run(tracks: list[pa.Table]) -> pa.Table:
        names, centres, powers = [], [], []
        for table in tracks:
            t, x = table.column("t").to_numpy().astype(float), filled(table.column(column).to_numpy().astype(float))
            at, even = resampled(t, x, fs)
            centre, power = band_series(at, even, fs, window_s, hop_s, band)
            names.append(pa.repeat(table.column("track")[0], power.size))
            centres.append(centre)
            powers.append(power)
        return pa.table({"track": pa.chunked_array(names).combine_chunks(), "t": np.concatenate(centres), "power": np.concatenate(powers)})

    return in_tracks(df.where(f"{column} is not null").select("track", "t", "idx", column), run, "track long, t double, power double")


def shared_out(sizes: list[int], most: int = FILTERED) -> Iterator[list[int]]:
    """Places of series of like lengths (half the longest or more), as many as have ``most`` samples when padded to the longest."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    while order:
        n = max(1, min(most // max(1, sizes[order[0]]), sum(2 * sizes[i] >= sizes[order[0]] for i in order)))
        yield order[:n]
        order = order[n:]


def sparse(df: DataFrame, column: str = "value", fs: float = 1.0, penalty: float = 5.0) -> DataFrame:
    k = kernel(fs)

    def run(tracks):
        out = [{} for _ in tracks]
        for places in shared_out([x.size for _, x in tracks]):
            solved = sparse_solved_of([tracks[i][1] - tracks[i][1].min() for i in places], k, penalty, ROUNDS)
            for i, (driver, converged) in zip(places, solved, strict=True):
                out[i] = {"driver": driver, "converged": np.full(driver.size, converged)}
        return out

    return per_tracks(df, column, {"driver": "double", "converged": "boolean"}, run)


def sympathetic_series(df: DataFrame, column: str = "value", fs: float = 1.0) -> DataFrame:
    """``power`` at each sample of a track: band power in hops of the chain's signal, brought back to the samples' times."""

    def run(tracks):
        out = [{} for _ in tracks]
        for places in shared_out([int((t[-1] - t[0]) * fs) + 1 for t, _ in tracks]):
            even = [resampled(t - t[0], x, fs)[1] for t, x in (tracks[i] for i in places)]
            for i, low in zip(places, chains(even, fs), strict=True):
                t = tracks[i][0]
                centre, power = band_series(np.array([0.0]), low, 2.0) if low.size else (np.empty(0), np.empty(0))
                out[i] = {"power": at_samples(centre, power, t - t[0])}
        return out

    return per_tracks(df, column, {"power": "double"}, run)


QUERIES = {"spectral_sympathetic": lambda s, d: sympathetic_series(events(s, d).withColumn("t", F.col("t") / 3600), fs=10.0), "spectral_bands": lambda s, d: banded(events(s, d)), "sparse_driver": lambda s, d: sparse(events(s, d))}
ORACLE_SQL: dict[str, str] = {}
