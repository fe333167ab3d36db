"""The drivers go on until their stop rule holds, and say whether they did."""

import numpy as np
import pytest

from dermotrace.operators import signal, spectral


def plain(x, k, least):
    rest, driver, energy = x.copy(), np.zeros(x.size), float(k @ k)
    while True:
        gain = np.correlate(np.concatenate((rest, np.zeros(k.size - 1))), k, "valid") / energy
        at = int(np.argmax(gain))
        if gain[at] < least:
            return driver, rest
        driver[at] += gain[at]
        n = min(k.size, x.size - at)
        rest[at : at + n] -= gain[at] * k[:n]


@pytest.mark.parametrize("n", [1, 40, 1024, 3000])
def test_long_track(n):
    k, rng = signal.kernel(1.0), np.random.default_rng(n)
    x = rng.random(n) * 20
    driver, converged = signal.pursued(x, k, 1.0)
    assert converged and np.allclose(driver, plain(x, k, 1.0)[0])
    if n == 3000:
        assert np.count_nonzero(driver) > 200 and np.flatnonzero(driver)[-1] > 2900
        short, done = signal.pursued(x, k, 1.0, most=200)
        assert not done and np.count_nonzero(short) <= 200


def test_not_converged():
    k = signal.kernel(1.0)
    assert not signal.pursued(np.array([1.0, np.inf]), k, 1.0)[1]
    x = np.random.default_rng(2).random(80) * 50
    assert not spectral.sparse_solved(x, k, 5.0, 1)[1] and spectral.sparse_solved(x, k, 5.0, spectral.ROUNDS)[1]


@pytest.mark.parametrize("make", [signal.driven, spectral.sparse])
def test_column(spark, make):
    df = spark.createDataFrame([(1, float(i), i, float(i * 37 % 50)) for i in range(700)], "track long, t double, idx long, value double")
    rows = make(df).collect()
    assert len(rows) == 700 and all(r.converged for r in rows) and max(r.t for r in rows if r.driver) > 650


@pytest.mark.parametrize("rounds", [1, 3, 40, spectral.ROUNDS])
def test_drivers_of_many_signals_are_those_of_each(rounds):
    """All signals take a place together; lengths, rounds and the hand-over of the last few leave each result as it was."""
    rng, k = np.random.default_rng(4), signal.kernel(1.0)
    xs = [np.abs(rng.normal(size=n)) * 60 for n in (1, 2, 5, 11, 12, 40, 41, 60, 67, 80, 99, 99)] + [np.zeros(30), np.full(20, 1.0), np.empty(0)]
    for got, x in zip(spectral.sparse_solved_of(xs, k, 5.0, rounds), xs, strict=True):
        want = spectral.sparse_solved(x, k, 5.0, rounds)
        assert got[1] == want[1] and got[0].size == x.size and np.allclose(got[0], want[0], rtol=0, atol=1e-9)
