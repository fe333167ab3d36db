"""An orthogonal wavelet transform with six taps, its inverse, and shrinkage that doesn't depend on where the signal begins."""

from __future__ import annotations

import numpy as np

#: The scaling filter of Daubechies' wavelet with three vanishing moments.
SCALING = (0.3326705529500826, 0.8068915093110925, 0.4598775021184915, -0.1350110200102546, -0.0854412738820267, 0.0352262918857095)


def _filters() -> tuple[np.ndarray, np.ndarray]:
    low = np.array(SCALING)
    return low, low[::-1] * np.array([1, -1, 1, -1, 1, -1])


def padded(x: np.ndarray) -> np.ndarray:
    """Mirrored to a power of two, 8 at least."""
    n = max(8, 1 << max(0, x.size - 1).bit_length())
    return x[:0] if not x.size else np.pad(x, (0, n - x.size), mode="symmetric")


def _step(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = (2 * np.arange(x.size // 2)[:, None] + np.arange(6)) % x.size
    low, high = _filters()
    return x[at] @ low, x[at] @ high


def _back(low_part: np.ndarray, high_part: np.ndarray) -> np.ndarray:
    n = 2 * low_part.size
    at = (2 * np.arange(low_part.size)[:, None] + np.arange(6)) % n
    low, high = _filters()
    out = np.zeros(n)
    np.add.at(out, at, low_part[:, None] * low + high_part[:, None] * high)
    return out


def decompose(x: np.ndarray, levels: int) -> list[np.ndarray]:
    """[slow part, details from the slowest to the fastest] of the padded signal; levels as far as six taps fit."""
    slow, details = padded(np.asarray(x, float)), []
    for _ in range(levels):
        if slow.size < 8:
            break
        slow, detail = _step(slow)
        details.append(detail)
    return [slow, *details[::-1]]


def rebuild(parts: list[np.ndarray], n: int) -> np.ndarray:
    slow = parts[0]
    for detail in parts[1:]:
        slow = _back(slow, detail)
    return slow[:n]


def shrunk(x: np.ndarray, levels: int, shifts: int = 8) -> np.ndarray:
    """Details under a threshold of their noise go to zero, larger ones shrink by it; the mean over some shifts of the signal."""
    y, out = padded(np.asarray(x, float)), np.zeros(x.size)
    for s in range(shifts):
        parts = decompose(np.roll(y, s), levels)
        sigma = np.median(np.abs(parts[-1])) / 0.6745 if len(parts) > 1 else 0.0
        limit = sigma * np.sqrt(2 * np.log(max(2, y.size)))
        soft = [parts[0], *(np.sign(p) * np.maximum(0, np.abs(p) - limit) for p in parts[1:])]
        out += np.roll(rebuild(soft, y.size), -s)[: x.size]
    return out / shifts
