"""Pulse vectors from their index, the rotation that spreads them, and the bits that a frame's bands get.

A vector of n whole numbers whose sizes add up to k has an index: vectors are in order of their first
number (k, k-1, ..., 1, 0, -k, ..., -1), then of the rest. ``counts`` is the table of how many there are,
made by its recurrence; an index unfolds along it, all rows of a batch with equal n and k side by side.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@lru_cache(64)
def counts(n: int, k: int) -> np.ndarray:
    """u[m, j], m <= n, j <= k + 1: vectors of m numbers and j pulses that begin with a negative number; u[m, j] + u[m, j+1] is how many there are."""
    u = np.zeros((n + 1, k + 2), np.int64)
    u[1:, 1] = 1
    u[1, 1:] = 1
    for m in range(2, n + 1):
        for j in range(2, k + 2):
            u[m, j] = u[m, j - 1] + u[m - 1, j - 1] + u[m - 1, j]
    return u


def vectors(n: int, k: int) -> int:
    u = counts(n, k)
    return int(u[n, k] + u[n, k + 1])


def unrank(n: int, k: int, index: np.ndarray) -> np.ndarray:
    """Rows of the vectors with these indices."""
    u = counts(n, k)
    i, left = index.astype(np.int64), np.full(len(index), k, np.int64)
    out = np.zeros((len(index), n), np.int32)
    for j in range(n):
        row = u[n - j]
        bound = row[left + 1]
        minus = i >= bound
        i = i - np.where(minus, bound, 0)
        rest = np.minimum(np.searchsorted(row[: k + 1], i, side="right") - 1, left)
        i = i - row[rest]
        out[:, j] = np.where(minus, rest - left, left - rest)
        left = rest
    return out


def rank(y: np.ndarray) -> int:
    """The index of a vector."""
    n, left = len(y), int(np.abs(y).sum())
    u = counts(n, left)
    total = 0
    for j, v in enumerate(y):
        rest = left - abs(int(v))
        total += int(u[n - j, rest]) + (int(u[n - j, left + 1]) if v < 0 else 0)
        left = rest
    return total


def _rows_alike(df: DataFrame, columns: list[str], alike: list[int], run, out: str, kind: str) -> DataFrame:
    """``run`` on groups of rows with equal values in the columns numbered ``alike``; its rows of results, as lists, in a new column."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    names = df.columns

    def kernel(batches):
        for b in batches:
            cols = [b.column(names.index(c)) for c in columns]
            keys = list(zip(*(cols[i].to_pylist() for i in alike), strict=True))
            place: dict[tuple, list[int]] = {}
            for i, key in enumerate(keys):
                place.setdefault(key, []).append(i)
            parts, at = [], []
            for key, rows in place.items():
                take = pa.array(rows)
                parts.append(run(key, [c.take(take) for c in cols]))
                at += rows
            sizes = np.repeat([p.shape[1] for p in parts], [len(p) for p in parts]) if parts else []
            lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32), pa.array(np.concatenate([p.ravel() for p in parts]) if parts else []))
            yield pa.RecordBatch.from_arrays([*b.columns, lists.take(pa.array(np.argsort(np.array(at, np.int64))))], names=[*names, out])

    return df.mapInArrow(kernel, f"{kinds}, `{out}` array<{kind}>")


def pulse_vectors(df: DataFrame, out: str = "y") -> DataFrame:
    """(..., n int, k int, index long) with the vector of that index in ``out``."""
    return _rows_alike(df, ["n", "k", "index"], [0, 1], lambda key, cols: unrank(*key, np.asarray(cols[2])), out, "int")


# --------------------------------------------------------------------------- rotation
def _sweep(x: np.ndarray, step: int, c: float, s: float) -> None:
    """Rotations of lines ``step`` apart, up the lines and down again but for the last pair; rows side by side."""
    n = x.shape[1]
    for i in [*range(n - step), *range(n - 2 * step - 1, -1, -1)]:
        a, b = x[:, i].copy(), x[:, i + step].copy()
        x[:, i], x[:, i + step] = c * a - s * b, c * b + s * a


def spread_angle(n: int, k: int, spread: int) -> tuple[float, float]:
    """Cosine and sine of the rotation for n lines with k pulses; ``spread`` from 1, the widest."""
    gain = n / (n + {1: 15, 2: 10, 3: 5}[spread] * k)
    theta = gain * gain / 2
    return math.cos(math.pi / 2 * theta), math.cos(math.pi / 2 * (1 - theta))


def wide_step(n: int, blocks: int) -> int:
    """How far apart the lines of the first sweep are; 0: there is none."""
    if n < 8 * blocks:
        return 0
    step = 1
    while (step * step + step) * blocks + (blocks >> 2) < n:
        step += 1
    return step


def rotate(x: np.ndarray, blocks: int, k: int, spread: int, forward: bool = False) -> np.ndarray:
    """Rows of lines with their pulses spread (or gathered again), each of ``blocks`` parts by itself."""
    n = x.shape[1]
    out = x.astype(np.float64).copy()
    if spread == 0 or 2 * k >= n:
        return out
    c, s = spread_angle(n, k, spread)
    wide, size = wide_step(n, blocks), n // blocks
    for i in range(blocks):
        part = out[:, i * size : (i + 1) * size]
        if forward:
            _sweep(part, 1, c, -s)
            if wide:
                _sweep(part, wide, s, -c)
        else:
            if wide:
                _sweep(part, wide, s, c)
            _sweep(part, 1, c, s)
    return out


def spread_rotation(df: DataFrame, forward: bool = False) -> DataFrame:
    """(..., x array<double>, blocks int, k int, spread int) with x rotated; a shape's lines are few, so a row is its task's unit."""
    sized = df.withColumn("_size", F.size("x"))

    def run(key, cols):
        return rotate(np.asarray(cols[4].flatten()).reshape(-1, key[3]), *key[:3], forward) if key[3] > 0 else np.zeros((len(cols[4]), 0))

    done = _rows_alike(sized, ["blocks", "k", "spread", "_size", "x"], [0, 1, 2, 3], run, "_y", "double")
    return done.withColumn("x", F.col("_y")).drop("_y", "_size")


# --------------------------------------------------------------------------- bits
def pulse_costs(n: int, most: int) -> list[int]:
    """Eighths of a bit that an index of a vector with 0, 1, ... pulses takes, rounded up."""
    return [0, *(math.ceil(8 * math.log2(vectors(n, k)) - 1e-9) for k in range(1, most + 1))]


def pulses_for(costs: Column, bits: Column) -> Column:
    """How many pulses come nearest to a number of eighths of bits, the fewer on a tie: bisection in a rising array of costs."""
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(costs).cast("double") + 1)).cast("int"))
    start = F.struct(F.lit(0).alias("lo"), (F.size(costs) - 1).alias("hi"))

    def halve(s, _):
        mid = F.shiftright(s["lo"] + s["hi"] + 1, 1)
        high = F.get(costs, mid) >= bits
        return F.struct(F.when(high, s["lo"]).otherwise(mid).alias("lo"), F.when(high, mid).otherwise(s["hi"]).alias("hi"))

    end = lambda s: F.when(bits - F.get(costs, s["lo"]) <= F.get(costs, s["hi"]) - bits, s["lo"]).otherwise(s["hi"])
    return F.aggregate(steps, start, halve, end)


def let(value: Column, then) -> Column:
    """``then`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _spent(bits: Column, least: Column, caps: Column, floor: int) -> Column:
    """What bands' bits come to, from the top: those above the highest band that reaches its least count ``floor`` or nothing."""

    def add(s, e):
        on = s["on"] | (e["b"] >= e["least"])
        more = F.when(on, F.least(e["b"], e["cap"])).when(e["b"] >= floor, F.lit(floor)).otherwise(0)
        return F.struct(on.alias("on"), (s["sum"] + more).cast("int").alias("sum"))

    zipped = F.reverse(F.zip_with(F.zip_with(bits, least, lambda b, t: F.struct(b.alias("b"), t.alias("least"))), caps, lambda e, c: F.struct(e["b"].alias("b"), e["least"].alias("least"), c.alias("cap"))))
    return F.aggregate(zipped, F.struct(F.lit(False).alias("on"), F.lit(0).alias("sum")), add, lambda s: s["sum"])


def tilted_rows(edges: list[int], vectors_: list[list[int]], channels: int, size: int, trim: int) -> tuple[list[list[int]], list[int]]:
    """Eighths of bits of all bands for every row at a trim, and what the trim gives each band."""
    bands = len(edges) - 1
    width = [edges[j + 1] - edges[j] for j in range(bands)]
    turn = size + 3 - 6
    tilt = []
    for j, w in enumerate(width):
        t = channels * w * (trim - 5 - size) * (bands - 1 - j)
        tilt.append((t << turn if turn >= 0 else t >> -turn) - (channels << 3 if w << size == 1 else 0))
    rows = [[channels * w * v << size >> 2 for w, v in zip(width, r, strict=True)] for r in vectors_]
    return [[max(0, b + t) if b > 0 else 0 for b, t in zip(r, tilt, strict=True)] for r in rows], tilt


def allocate(df: DataFrame, edges: list[int], vectors_: list[list[int]], channels: int, size: int) -> DataFrame:
    """(frame, total int, trim int, caps array<int>, extra array<int>) -> (frame, level, step, bits array<int>) in eighths of bits.

    ``vectors_``: rising rows of bits a line and band; ``size``: log2 of how often a frame's shortest block fits; trims go from 0
    to 10. The search takes the highest row within the total, then the most of 64 steps towards the next row, both by bisection;
    then bands that don't reach their least, from the top, get the floor or nothing.
    """
    width = [z - a for a, z in zip(edges, edges[1:], strict=False)]
    floor, top = channels << 3, len(vectors_) - 1
    least = F.array(*[F.lit(max(floor, (3 * w << size << 3) >> 4)) for w in width])
    trims = [(t, *tilted_rows(edges, vectors_, channels, size, t)) for t in range(11)]
    table = F.broadcast(df.sparkSession.createDataFrame(trims, "trim int, _rows array<array<int>>, _tilt array<int>"))  # eleven rows

    more = lambda bits: F.zip_with(bits, F.col("extra"), lambda b, e: b + e)
    spent = lambda bits: _spent(bits, least, F.col("caps"), floor)

    def search(lo: int, hi: int, cost) -> Column:
        """The last of lo..hi whose cost is within the total, by bisection (lo - 1 where none is)."""

        def halve(s, _):
            def turn(mid):
                return let(cost(mid) > F.col("total"), lambda over: F.struct(F.when(~over, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(over, mid - 1).otherwise(s["hi"]).alias("hi")))

            return F.when(s["lo"] <= s["hi"], let(F.shiftright(s["lo"] + s["hi"], 1), turn)).otherwise(s)

        steps = F.sequence(F.lit(1), F.lit(max(1, (hi - lo + 1).bit_length())))
        return F.aggregate(steps, F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi")), halve, lambda s: s["lo"] - 1)

    def ends(level):
        low = F.when(level > 0, more(F.get("_rows", level))).otherwise(F.get("_rows", level))
        all_ = F.zip_with("caps", "_tilt", lambda b, t: F.when(b > 0, F.greatest(F.lit(0), b + t)).otherwise(0))
        high = more(F.when(level + 1 > top, all_).otherwise(F.get("_rows", F.least(level + 1, F.lit(top)))))
        return F.struct(level.alias("level"), low.alias("low"), high.alias("high"))

    def between(e, m):
        return F.zip_with(e["low"], e["high"], lambda l, h: l + F.shiftright(F.greatest(F.lit(0), h - l) * m, 6))

    def given(raw):
        first = F.array_max(F.filter(F.transform(F.zip_with(raw, least, lambda b, t: b >= t), lambda ok, j: F.when(ok, j).otherwise(-1)), lambda j: j >= 0))
        return let(F.coalesce(first, F.lit(-1)), lambda f: F.transform(F.zip_with(raw, F.col("caps"), lambda b, c: F.struct(b.alias("b"), c.alias("c"))), lambda e, j: F.least(e["c"], F.when(j <= f, e["b"]).when(e["b"] >= floor, F.lit(floor)).otherwise(0))))

    def settle(e):
        return let(F.greatest(F.lit(0), search(1, 63, lambda m: spent(between(e, m)))), lambda m: F.struct(e["level"].alias("level"), m.alias("step"), let(between(e, m), given).alias("bits")))

    found = let(let(search(1, top, lambda q: spent(more(F.get("_rows", q)))), ends), settle)
    return df.join(table, "trim").select("frame", found.alias("r")).select("frame", "r.*")
