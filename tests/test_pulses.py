"""Pulse vectors, rotations and bit searches against plain versions."""

import itertools
import math
import random

import numpy as np

from sonaril.operators import pulses
from sonaril.plans.shapes import EDGES, ROWS


def listed(n, k):
    every = [v for v in itertools.product(range(-k, k + 1), repeat=n) if sum(map(abs, v)) == k]
    return sorted(every, key=lambda v: [k - x if x >= 0 else 2 * k + 1 + x for x in v])


def test_indices_follow_the_order():
    for n, k in ((2, 1), (2, 5), (3, 3), (4, 4), (6, 2), (1, 3)):
        want = listed(n, k)
        assert pulses.vectors(n, k) == len(want)
        assert [tuple(v) for v in pulses.unrank(n, k, np.arange(len(want)))] == want
        assert [pulses.rank(np.array(v)) for v in want] == list(range(len(want)))


def test_wide_vectors_come_back(spark):
    rng = random.Random(1)
    rows = [(i, n, k, rng.randrange(pulses.vectors(n, k))) for i, (n, k) in enumerate([(16, 8), (32, 6), (176, 4), (8, 20), (4, 128), (2, 1), (3, 0)] * 6)]
    got = pulses.pulse_vectors(spark.createDataFrame(rows, "id int, n int, k int, index long")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert len(r.y) == r.n and sum(map(abs, r.y)) == r.k and pulses.rank(np.array(r.y)) == r["index"]


def plain_rotation(x, blocks, k, spread, forward):
    x, n = list(x), len(x)
    if 2 * k >= n or not spread:
        return x
    g = n / (n + [15, 10, 5][spread - 1] * k)
    c, s = math.cos(math.pi * g * g / 4), math.sin(math.pi * g * g / 4)
    wide = 0
    if n >= 8 * blocks:
        wide = next(w for w in range(1, n) if (w * w + w) * blocks + blocks // 4 >= n)
    size = n // blocks

    def sweep(off, step, c, s):
        for i in list(range(size - step)) + list(range(size - 2 * step - 1, -1, -1)):
            a, b = x[off + i], x[off + i + step]
            x[off + i + step], x[off + i] = c * b + s * a, c * a - s * b

    for b in range(blocks):
        for step, u, v in ([(1, c, -s)] + [(wide, s, -c)] * bool(wide)) if forward else ([(wide, s, c)] * bool(wide) + [(1, c, s)]):
            sweep(b * size, step, u, v)
    return x


def test_rotations(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(n)], blocks, k, spread) for i, (n, blocks, k, spread) in enumerate([(64, 1, 4, 2), (64, 4, 3, 1), (16, 1, 9, 3), (40, 2, 5, 3), (8, 1, 2, 0), (12, 1, 1, 1), (6, 2, 1, 2), (0, 1, 1, 1)] * 3)]
    df = spark.createDataFrame(rows, "id int, x array<double>, blocks int, k int, spread int")
    for forward in (False, True):
        got = {r.id: r.x for r in pulses.spread_rotation(df, forward).collect()}
        for i, x, *rest in rows:
            assert np.allclose(got[i], plain_rotation(x, *rest, forward), atol=1e-12)
    both = {r.id: r.x for r in pulses.spread_rotation(pulses.spread_rotation(df), True).collect()}
    for i, x, *_ in rows:
        assert np.allclose(both[i], x, atol=1e-9)  # one undoes the other


def test_pulses_for_bits(spark):
    costs = pulses.pulse_costs(8, 8)
    want = {b: min(range(9), key=lambda k: (abs(costs[k] - b), k)) for b in range(costs[-1] + 1)}
    df = spark.createDataFrame([(b, costs) for b in want], "b int, costs array<int>")
    assert {r.b: r.k for r in df.select("b", pulses.pulses_for(df.costs, df.b).alias("k")).collect()} == want


def plain_allocation(total, trim, caps, extra, channels, size):
    bands = len(caps)
    width = [EDGES[j + 1] - EDGES[j] for j in range(bands)]
    floor = channels * 8
    least = [max(floor, (3 * w << size) * 8 >> 4) for w in width]

    def tilt(j):
        t = channels * width[j] * (trim - 5 - size) * (bands - 1 - j) * 2**size * 8
        return t // 64 - (floor if width[j] << size == 1 else 0)

    def base(q, j):
        b = caps[j] if q > 10 else channels * width[j] * ROWS[q][j] * 2**size // 4
        return max(0, b + tilt(j)) if b > 0 else b

    def settle(bits):
        out, on = [0] * bands, False
        for j in range(bands - 1, -1, -1):
            on = on or bits[j] >= least[j]
            out[j] = min(bits[j] if on else floor if bits[j] >= floor else 0, caps[j])
        return out

    level = max([q for q in range(1, 11) if sum(settle([base(q, j) + extra[j] for j in range(bands)])) <= total], default=0)
    low = [base(level, j) + (extra[j] if level else 0) for j in range(bands)]
    gap = [max(0, base(level + 1, j) + extra[j] - low[j]) for j in range(bands)]
    bits = lambda m: settle([a + (g * m >> 6) for a, g in zip(low, gap, strict=True)])
    step = max([m for m in range(64) if sum(bits(m)) <= total], default=0)
    return level, step, bits(step)


def test_allocation(spark):
    rng = random.Random(3)
    for channels, size in ((1, 2), (2, 0), (2, 3)):
        rows = [(i, rng.randrange(3000), rng.randrange(11), [rng.randrange(100, 400) for _ in range(8)], [rng.choice([0, 0, 8, 40]) for _ in range(8)]) for i in range(120)]
        df = spark.createDataFrame(rows, "frame int, total int, trim int, caps array<int>, extra array<int>")
        got = {r.frame: (r.level, r.step, list(r.bits)) for r in pulses.allocate(df, EDGES, ROWS, channels, size).collect()}
        assert got == {i: plain_allocation(*rest, channels, size) for i, *rest in rows}


def test_residues(spark):
    """Codes of several classes and passes, in every layout, against plain loops."""
    from sonaril.operators import floors

    rng = random.Random(4)
    books = {(c, p): rng.randrange(3) for c in range(3) for p in range(8) if rng.random() < 0.5}
    values = {(b, e): [rng.randrange(-8, 8) / 2 for _ in range(d)] for b, d in enumerate((1, 2, 4)) for e in range(5)}
    classes = {(f, ch, part): rng.randrange(3) for f in range(6) for ch in range(2) for part in range(5)}
    entries = [(f, ch, part, p, i, rng.randrange(5)) for (f, ch, part), c in classes.items() for p in range(8) if (c, p) in books for i in range(4 // len(values[books[c, p], 0]))]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    tables = frame([(*k, v) for k, v in classes.items()], "frame int, ch int, part int, class int"), frame([(*k, b) for k, b in books.items()], "class int, pass int, book int"), frame([(*k, v) for k, v in values.items()], "book int, entry int, v array<double>")
    for layout in (0, 1, 2):
        want = {}
        for f, ch, part, p, i, e in entries:
            if layout == 2 and ch:
                continue
            v = values[books[classes[f, ch, part], p], e]
            for j, x in enumerate(v):
                k = 2 + part * 4 + (i + j * (4 // len(v)) if layout == 0 else i * len(v) + j)
                key = (f, k % 2, k // 2) if layout == 2 else (f, ch, k)
                if key[2] < 19:
                    want[key] = want.get(key, 0) + x
        given = frame([r for r in entries if layout < 2 or not r[1]], "frame int, ch int, part int, pass int, i int, entry int")
        got = {(r.frame, r.ch, r.k): r.x for r in floors.residue(given, *tables, 4, layout, channels=2, begin=2, lines=19).collect()}
        assert got == want
