"""Recordings of very different rates in one table, and windows that no task holds."""

import numpy as np
import pytest

from tessera.operators import series as T

SCHEMA = "c int, i long, t double, y double"


def fitted(y, window, order):
    """Moving polynomial fit; whole windows at the ends, held edges if the recording is shorter."""
    m, q = window // 2, T.poly_basis(window, order)
    c = q @ q[m]
    out = np.array([c @ np.pad(y, m, mode="edge")[i : i + window] for i in range(len(y))])
    if len(y) >= window:
        out[:m] = (q @ (q.T @ y[:window]))[:m]
        out[len(y) - m :] = (q @ (q.T @ y[-window:]))[window - m :]
    return out


def test_slow_and_fast_recordings_in_one_table(spark):
    """2000 samples at 8 Hz and 50 samples at 1 MHz, a window of a minute: neither builds the window of the other."""
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=2000), rng.normal(size=50)
    rows = [(1, i, i / 8, float(v)) for i, v in enumerate(a)] + [(2, i, i * 1e-6, float(v)) for i, v in enumerate(b)]
    out = {}
    for r in T.smooth_detrend(spark.createDataFrame(rows, SCHEMA), ["c"], None, 60.0, 3).orderBy("i").collect():
        out.setdefault(r["c"], []).append(r["y"])
    np.testing.assert_allclose(out[1], a - fitted(a, 479, 3), atol=1e-9)
    # A window of a minute at 1 MHz sees almost only the held edges: half of it on either side.
    np.testing.assert_allclose(out[2], b - (b[0] + b[-1]) / 2, atol=1e-3)


@pytest.mark.parametrize("n,window", [(400, 101), (60, 101), (101, 101), (2000, 31)])
@pytest.mark.parametrize("order", [3, 5])
def test_running_sums_fit_like_windows(spark, n, window, order):
    rng = np.random.default_rng(n + window)
    y = rng.normal(size=n) + np.linspace(0, 5, n) ** 2
    d = spark.createDataFrame([(1, i, float(i), float(v)) for i, v in enumerate(y)], SCHEMA)
    long = {r["i"]: r["y"] for r in T.smooth_detrend(d, ["c"], None, window + 0.5, order, long=20).collect()}
    np.testing.assert_allclose([long[i] for i in range(n)], y - fitted(y, window, order), atol=1e-7)


def test_sums_of_powers_and_kernels_without_loops():
    for a, b in ((-5, 7), (-9, -3), (0, 9), (3, 3), (5, 4), (-3, -1), (-4, 4)):
        for k in range(7):
            assert T.power_sum(a, b, k) == sum(j**k for j in range(a, b + 1))
    assert T.power_sum(-(10**9), 10**9, 2) == 2 * (10**9 * (10**9 + 1) * (2 * 10**9 + 1) // 6)
    q = T.poly_basis(101, 3)
    np.testing.assert_allclose(T.trend_kernel(101, 3, 500), q @ q[50], atol=1e-14)
    rng = np.random.default_rng(2)
    for n in (1, 2, 40):
        y = rng.normal(size=n)
        full = np.convolve(np.pad(y, 50, mode="edge"), (q @ q[50])[::-1], mode="valid")
        np.testing.assert_allclose(T.held_convolution(y, T.trend_kernel(101, 3, n)), full, atol=1e-13)
        ker = np.array(T.gauss_kernel(30.0))
        full = np.convolve(np.pad(y, len(ker) // 2, mode="edge"), ker, mode="valid")
        np.testing.assert_allclose(T.held_convolution(y, T.smoothing_kernel(30.0, n)), full, atol=1e-13)
    assert abs(T.smoothing_kernel(1e7, 50).sum() - 1) < 1e-12 and len(T.smoothing_kernel(1e7, 50)) == 99
    y, ker = rng.normal(size=5000), np.array(T.gauss_kernel(300.0))
    np.testing.assert_allclose(T.held_convolution(y, ker), np.convolve(np.pad(y, len(ker) // 2, mode="edge"), ker, mode="valid"), atol=1e-12)
