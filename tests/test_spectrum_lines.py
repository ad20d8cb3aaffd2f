"""Filters of line spectra against polynomials in floating point."""

import random

import numpy as np
import pytest

from sonaril.operators import spectrum_lines as sl


def exact(lines):
    """The same filter by polynomial products: 1 - A = (P (1 + z) + Q (1 - z)) / 2."""
    order = len(lines)
    roots = lambda some: np.real(np.poly([e for x in some for e in (np.exp(1j * np.pi * x / 32768), np.exp(-1j * np.pi * x / 32768))]))
    p, q = np.convolve(roots(lines[::2]), [1, 1]), np.convolve(roots(lines[1::2]), [1, -1])
    return -((p + q) / 2)[1 : order + 1]


def spread(rng, order, jitter):
    return sorted(max(1, min(32767, (k + 1) * 32768 // (order + 1) + rng.randrange(-jitter, jitter + 1))) for k in range(order))


@pytest.mark.parametrize("order", [10, 16])
def test_lines_far_apart(order):
    rng = random.Random(order)
    for _ in range(60):
        lines = spread(rng, order, 700)
        a = sl.filter_of(lines)
        assert np.abs(np.array(a) / 4096 - exact(lines)).max() < 0.01 and sl.stability(a) > 0


@pytest.mark.parametrize("order", [10, 16])
def test_lines_close_together_still_give_stable_filters(order):
    """Clustered lines make sharp resonances or great coefficients: the result is stable and fits 16 bits."""
    rng = random.Random(order + 1)
    widened = 0
    for _ in range(150):
        base = rng.randrange(200, 30000)
        lines = sorted(min(32767, max(1, base + rng.randrange(1200))) for _ in range(order)) if rng.random() < 0.6 else spread(rng, order, 6000)
        a = sl.filter_of(lines)
        assert all(-32768 <= v <= 32767 for v in a) and sl.stability(a) > 0
        assert np.abs(np.roots([1, *(-np.array(a) / 4096)])).max() < 1
        widened += np.abs(np.array(a) / 4096 - exact(lines)).max() > 0.05
    assert widened > 5


def test_stability_agrees_with_the_roots():
    rng = random.Random(3)
    seen = set()
    for _ in range(300):
        a = [round(4096 * rng.gauss(0, 0.9 / (i + 1))) for i in range(10)]
        r = np.abs(np.roots([1, *(-np.array(a) / 4096)])).max()
        if r < 0.98 or r > 1.001:
            seen.add(r < 1)
            assert (sl.stability(a) > 0) == (r < 1)
    assert seen == {True, False}


def test_frames(spark):
    rng = random.Random(5)
    rows = [(i, spread(rng, rng.choice([10, 16]), 900)) for i in range(40)]
    got = {r.id: list(r.a) for r in sl.line_filters(spark.createDataFrame(rows, "id int, lines array<int>")).collect()}
    assert got == {i: sl.filter_of(x) for i, x in rows}
