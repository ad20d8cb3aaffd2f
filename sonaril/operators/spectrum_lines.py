"""Line spectra to prediction filters in fixed point: two polynomials from the lines, a fit to 16 bits, and a stability test.

A frame's lines rise from 0 to 2^15. The cosines of every second one are the roots of a polynomial; the sum and
the difference of two such polynomials are the filter. A filter that isn't stable, by its reflection coefficients, has
its resonances widened step by step until it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Cosines of 0 to a quarter turn in 64 steps, doubled, of 13 bits (the rest mirrors them), and the order that lines enter the polynomials in.
COSINES = [
    8192, 8190, 8182, 8170, 8152, 8130, 8104, 8072, 8034, 7994, 7946, 7896, 7840, 7778, 7714, 7644, 7568, 7490, 7406, 7318, 7226, 7128, 7026, 6922, 6812, 6698, 6580, 6458, 6332, 6204, 6070, 5934,
    5792, 5648, 5502, 5352, 5198, 5040, 4880, 4718, 4552, 4382, 4212, 4038, 3862, 3684, 3502, 3320, 3136, 2948, 2760, 2570, 2378, 2186, 1990, 1794, 1598, 1400, 1202, 1002, 802, 602, 402, 202, 0,
]
ENTRY = {10: (0, 9, 6, 3, 4, 5, 8, 1, 2, 7), 16: (0, 15, 8, 7, 4, 11, 12, 3, 2, 13, 10, 5, 6, 9, 14, 1)}


def _half_up(x: int, n: int) -> int:
    return ((x >> (n - 1)) + 1) >> 1


def _within(x: int, bits: int) -> int:
    return max(-(1 << bits - 1), min((1 << bits - 1) - 1, x))


def cosine(line: int) -> int:
    """Cosine of a line by the table and a straight line between its values, of 17 bits."""
    at, part = line >> 8, line & 255
    value = lambda i: COSINES[i] if i <= 64 else -COSINES[128 - i]
    return _half_up((value(at) << 8) + (value(at + 1) - value(at)) * part, 4)


def polynomial(roots: list[int]) -> list[int]:
    """Coefficients of the product of 1 - 2 r z + z^2 over the roots, up to its middle."""
    out = [1 << 16, -roots[0]]
    for k, r in enumerate(roots[1:], 1):
        old = out
        out = [*old, 2 * old[k - 1] - _half_up(r * old[k], 16)]
        for n in range(k, 1, -1):
            out[n] = old[n] + old[n - 2] - _half_up(r * old[n - 1], 16)
        out[1] = old[1] - r
    return out


def widen(a: list[int], factor: int) -> list[int]:
    """Coefficient i times the (i+1)-th power of a factor of 16 bits."""
    out, step = [], factor - (1 << 16)
    for v in a[:-1]:
        out.append(factor * v >> 16)
        factor += _half_up(factor * step, 16)
    return [*out, factor * a[-1] >> 16]


def fit(a: list[int]) -> tuple[list[int], list[int]]:
    """Coefficients of 12 bits that fit 16, and the 17-bit ones that they come from; too great ones are widened up to ten times, then clipped."""
    for _ in range(10):
        most = max(range(len(a)), key=lambda i: (abs(a[i]), -i))
        size = _half_up(abs(a[most]), 5)
        if size <= 32767:
            return [_half_up(v, 5) for v in a], a
        size = min(size, 163838)
        a = widen(a, 65470 - ((size - 32767) << 14) // (size * (most + 1) >> 2))
    clipped = [_within(_half_up(v, 5), 16) for v in a]
    return clipped, [v << 5 for v in clipped]


def _inverse(b: int, bits: int) -> int:
    """2^bits / b by a first guess and one correction."""
    head = 31 - abs(b).bit_length()
    norm = b << head
    guess = (((1 << 31) - 1) >> 2) // (norm >> 16) if norm > 0 else -((((1 << 31) - 1) >> 2) // -(norm >> 16))
    low = (guess + 32768 & 65535) - 32768
    rest = ((1 << 29) - (norm * low >> 16)) << 3
    out, shift = (guess << 16) + (rest * guess >> 16), 61 - head - bits
    return _within(out << -shift, 32) if shift <= 0 else out >> shift if shift < 32 else 0


def stability(a: list[int]) -> int:
    """Inverse of the prediction gain, 30 bits, by stepping down to the reflection coefficients; 0 for a filter that isn't stable."""
    if sum(a) >= 4096:
        return 0
    c, gain = [v << 12 for v in a], 1 << 30
    for k in range(len(a) - 1, -1, -1):
        if abs(c[k]) > 16773022:
            return 0
        r = -(c[k] << 7)
        rest = (1 << 30) - (r * r >> 32)
        gain = (gain * rest >> 32) << 2
        if gain < 107374:
            return 0
        if k:
            bits = abs(rest).bit_length()
            scale = _inverse(rest, bits + 30)
            for n in range((k + 1) >> 1):
                x, y = c[n], c[k - n - 1]
                u = _half_up(_within(x - _half_up(y * r, 31), 32) * scale, bits)
                v = _half_up(_within(y - _half_up(x * r, 31), 32) * scale, bits)
                if _within(u, 32) != u or _within(v, 32) != v:
                    return 0
                c[n], c[k - n - 1] = u, v
    return gain


def filter_of(lines: list[int]) -> list[int]:
    """Prediction coefficients of 12 bits from 10 or 16 lines."""
    order = len(lines)
    cosines = [0] * order
    for place, line in zip(ENTRY[order], lines, strict=True):
        cosines[place] = cosine(line)
    p, q = polynomial(cosines[::2]), polynomial(cosines[1::2])
    half = order // 2
    total, apart = [p[k + 1] + p[k] for k in range(half)], [q[k + 1] - q[k] for k in range(half)]
    a32 = [-t - d for t, d in zip(total, apart, strict=True)] + [d - t for t, d in zip(reversed(total), reversed(apart), strict=True)]
    a, a32 = fit(a32)
    for i in range(16):
        if stability(a):
            break
        a32 = widen(a32, 65536 - (2 << i))
        a = [_within(_half_up(v, 5), 16) for v in a32]
    return a


def line_filters(df: DataFrame, lines: str = "lines", out: str = "a") -> DataFrame:
    """(..., lines array<int> of 10 or 16) with the filter's coefficients in ``out``; a frame is a few hundred steps."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    names = df.columns

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [filter_of(x) for x in b.column(names.index(lines)).to_pylist()]
            at = np.cumsum([0, *map(len, made)]).astype(np.int32)
            flat = np.array([v for a in made for v in a], np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(at, pa.array(flat))], names=[*names, out])

    return df.mapInArrow(run, f"{kinds}, `{out}` array<int>")
