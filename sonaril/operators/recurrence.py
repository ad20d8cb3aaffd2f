"""Linear recurrences along streams, as a scan of affine maps over blocks.

y[n] = x[n] + c1 y[n-1] + ... + ck y[n-k] moves a state, the last k outputs, by an affine map a sample:
s -> A s + b. Maps compose, and A is the same everywhere, so a block of samples from a state of zeros
gives the block's b, and its A is a fixed power. States are handed on over blocks by the same scan, one
row a block, over groups of blocks, one row a group: a stream of any length is no task of its own. Then
every block starts from its state. Inside a block, lanes of ``LANE`` samples run side by side in numpy
and are joined in the same way. Integers are exact (modulo 2^64); floats differ from a plain loop by rounding.

Streams have running numbers (see ``ordering.ordinal``). What isn't linear, or has coefficients of its own
in every frame, runs along its frame, all frames of a batch side by side (``all_pole``, ``lpc_restore``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonaril.operators.ordering import carry, previous

BLOCK, LANE, GROUP = 1 << 12, 64, 1 << 10
ROWS = 128  # blocks that a kernel handles at once


def _responses(coeffs: np.ndarray, n: int) -> np.ndarray:
    """What each of the k last outputs (latest first) adds to the next n outputs."""
    k = len(coeffs)
    y = np.zeros((k, k + n), coeffs.dtype)
    y[:, :k] = np.eye(k, dtype=coeffs.dtype)[:, ::-1]
    for t in range(n):
        y[:, k + t] = (y[:, t : k + t][:, ::-1] * coeffs).sum(axis=1)
    return y[:, k:]


def scan_rows(x: np.ndarray, coeffs: np.ndarray, state: np.ndarray | None = None) -> np.ndarray:
    """Rows of samples (R, n) through the recurrence, each from its state (R, k; latest output first) or from zeros."""
    rows, n = x.shape
    k = len(coeffs)
    lane = max(LANE, k)
    lanes = -(-n // lane) if n else 0
    y = np.zeros((rows, lanes, lane + k), x.dtype)
    padded = np.zeros((rows, lanes * lane), x.dtype)
    padded[:, :n] = x
    y[:, :, k:] = padded.reshape(rows, lanes, lane)
    for t in range(lane):
        for j in range(k):
            y[:, :, k + t] += coeffs[j] * y[:, :, k + t - 1 - j]
    y = y[:, :, k:]
    reach = _responses(coeffs, lane)
    s = np.zeros((rows, k), x.dtype) if state is None else state.astype(x.dtype)
    for i in range(lanes):
        y[:, i] += s @ reach
        s = y[:, i, : -k - 1 : -1]
    return y.reshape(rows, -1)[:, :n]


def _power(coeffs: np.ndarray, n: int) -> np.ndarray:
    """The matrix of n steps on a state (latest first), by squaring."""
    k = len(coeffs)
    a = np.zeros((k, k), coeffs.dtype)
    a[0] = coeffs
    a[1:, :-1] += np.eye(k - 1, dtype=coeffs.dtype)
    out = np.eye(k, dtype=coeffs.dtype)
    while n:
        if n & 1:
            out = out @ a
        a, n = a @ a, n >> 1
    return out


def _lists(col) -> np.ndarray:
    return np.asarray(col.flatten())


def _hand_on(ends: DataFrame, step: np.ndarray, kind: str, group: int) -> DataFrame:
    """(stream_id, block, b) of all blocks -> (stream_id, block, s): the state that each starts from.

    Groups of blocks are summed up from zeros, their own starts are found along one row a group, and handed to their blocks.
    """
    k = len(step)
    far = np.linalg.matrix_power(step, group)

    def along(rows, m, emit):
        """Rows of lists of (number, b) through s -> m s + b."""
        for b in rows:
            for i in range(b.num_rows):
                each = b.column(b.num_columns - 1)[i].values
                at, add = np.asarray(each.field("at")), _lists(each.field("b")).reshape(-1, k)
                s = np.zeros(k, step.dtype)
                starts, last = np.empty_like(add), None
                for j in range(len(at)):  # numbers without gaps
                    starts[j] = s
                    s = m @ s + add[j]
                yield emit(b.slice(i, 1), at, starts, s)

    def row_lists(v):
        return pa.ListArray.from_arrays(np.arange(0, v.size + 1, k, dtype=np.int32), pa.array(v.ravel()))

    listed = F.array_sort(F.collect_list(F.struct(F.col("block").alias("at"), "b"))).alias("each")
    grouped = ends.groupBy("stream_id", F.floor(F.col("block") / group).alias("g")).agg(listed)

    def summed(rows):
        return along(rows, step, lambda r, at, starts, s: pa.RecordBatch.from_arrays([r.column(0), r.column(1), row_lists(s[None, :])], names=["stream_id", "block", "b"]))

    totals = grouped.mapInArrow(summed, f"stream_id {ends.schema['stream_id'].dataType.simpleString()}, block long, b array<{kind}>")
    tops = totals.groupBy("stream_id").agg(listed)  # a row for a group of blocks: 4 million samples

    def topped(rows):
        return along(rows, far, lambda r, at, starts, s: pa.RecordBatch.from_arrays([r.column(0).take(pa.array(np.zeros(len(at), np.int64))), pa.array(at), row_lists(starts)], names=["stream_id", "g", "s"]))

    heads = tops.mapInArrow(topped, f"stream_id {ends.schema['stream_id'].dataType.simpleString()}, g long, s array<{kind}>")

    def handed(rows):
        for b in rows:
            for i in range(b.num_rows):
                each = b.column(2)[i].values
                at, add = np.asarray(each.field("at")), _lists(each.field("b")).reshape(-1, k)
                s = np.asarray(b.column(3)[i].values)
                starts = np.empty_like(add)
                for j in range(len(at)):
                    starts[j] = s
                    s = step @ s + add[j]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.full(len(at), i))), pa.array(at), row_lists(starts)], names=["stream_id", "block", "s"])

    return grouped.join(heads, ["stream_id", "g"]).select("stream_id", "g", "each", "s").mapInArrow(handed, f"stream_id {ends.schema['stream_id'].dataType.simpleString()}, block long, s array<{kind}>")


def linear_recurrence(df: DataFrame, coeffs: list, value: str = "x", out: str = "y", warm: int = 0, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """(stream_id, n, value) -> (stream_id, n, out): out[n] = value[n] + sum of coeffs[j-1] out[n-j], from zeros; whole numbers stay exact.

    The first ``warm`` values are outputs themselves.
    """
    whole = all(isinstance(c, int) for c in coeffs)
    kind, dtype = ("long", np.int64) if whole else ("double", np.float64)
    c = np.array(coeffs, dtype)
    k = len(c)
    at = F.floor(F.col("n") / block)
    listed = df.groupBy("stream_id", at.alias("block")).agg(F.array_sort(F.collect_list(F.struct("n", F.col(value).cast(kind).alias("x")))).alias("each"))
    blocks = listed.select("stream_id", "block", F.transform("each", lambda v: v["x"]).alias("x"))
    sid = df.schema["stream_id"].dataType.simpleString()

    def chunks(rows) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        for b in rows:
            for i in range(0, b.num_rows, ROWS):
                part = b.slice(i, ROWS)
                size = np.asarray(part.column(2).value_lengths())
                x = np.zeros((part.num_rows, int(size.max())), dtype)
                x[np.arange(x.shape[1])[None, :] < size[:, None]] = _lists(part.column(2))
                first = np.flatnonzero(np.asarray(part.column(1)) == 0)
                for t in range(min(warm, x.shape[1]) - 1, -1, -1):  # the value that makes the given output
                    for j in range(min(t, k)):
                        x[first, t] -= c[j] * x[first, t - 1 - j]
                yield part, x, size

    def ends(rows):
        for part, x, size in chunks(rows):
            y = np.concatenate((np.zeros((len(x), k), dtype), scan_rows(x, c)), axis=1)
            last = np.take_along_axis(y, (size[:, None] + k - 1 - np.arange(k)[None, :]), axis=1)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(np.arange(0, last.size + 1, k, dtype=np.int32), pa.array(last.ravel()))], names=["stream_id", "block", "b"])

    def whole_blocks(rows):
        for part, x, size in chunks(rows):
            y = scan_rows(x, c, _lists(part.column(3)).reshape(-1, k))
            flat = y[np.arange(y.shape[1])[None, :] < size[:, None]]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(size))).astype(np.int32), pa.array(flat))], names=["stream_id", "block", "y"])

    starts = _hand_on(blocks.mapInArrow(ends, f"stream_id {sid}, block long, b array<{kind}>"), _power(c, block), kind, group)
    done = blocks.join(starts, ["stream_id", "block"]).select("stream_id", "block", "x", "s").mapInArrow(whole_blocks, f"stream_id {sid}, block long, y array<{kind}>")
    rows = done.select("stream_id", "block", F.posexplode("y").alias("i", out))
    return rows.select("stream_id", (F.col("block") * block + F.col("i")).alias("n"), out)


#: Fixed value: the coefficient of the de-emphasis at 48 kHz.
DEEMPHASIS = 0.8500061035


def deemphasis(df: DataFrame, coefficient: float = DEEMPHASIS, scale: float = 1 / 32768) -> DataFrame:
    """(stream_id, n, x) -> (stream_id, n, y): one pole along the stream, at full scale 1."""
    y = linear_recurrence(df.select("stream_id", "n", (F.col("x") + 1e-30).alias("x")), [coefficient])
    return y.select("stream_id", "n", (F.col("y") * scale).alias("y"))


# --------------------------------------------------------------------------- frames side by side
def along_frames(df: DataFrame, columns: list[str], run, out: str, kind: str) -> DataFrame:
    """Kernel over rows of lists: ``run`` takes padded arrays and their sizes, one pair a column, and gives a padded result sized like the first."""
    keep = [c for c in df.columns if c not in columns]
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def kernel(rows):
        for b in rows:
            for i in range(0, b.num_rows, ROWS):
                part = b.slice(i, ROWS)
                args = []
                for c in range(len(keep), len(keep) + len(columns)):
                    col = part.column(c)
                    size = np.asarray(col.value_lengths().fill_null(0))
                    flat = np.asarray(col.flatten())
                    x = np.zeros((part.num_rows, int(size.max()) if len(size) else 0), flat.dtype if flat.dtype != object else np.float64)
                    x[np.arange(x.shape[1])[None, :] < size[:, None]] = flat
                    args += [x, size]
                y, size = run(*args), args[1]
                flat = y[np.arange(y.shape[1])[None, :] < size[:, None]]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(size))).astype(np.int32), pa.array(flat))], names=[*keep, out])

    return df.select(*[F.col(f"`{c}`") for c in [*keep, *columns]]).mapInArrow(kernel, f"{kinds}, `{out}` array<{kind}>")


def all_pole_rows(x: np.ndarray, sizes: np.ndarray, lpc: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """Rows of lines through 1 / (1 + sum of lpc_i z^-i), each row with its own coefficients (0 beyond its order)."""
    k = lpc.shape[1]
    y = np.concatenate((np.zeros((len(x), k)), x.astype(np.float64)), axis=1)
    back = np.ascontiguousarray(lpc[:, ::-1])
    for t in range(x.shape[1]):
        y[:, k + t] -= (y[:, t : k + t] * back).sum(axis=1)
    return y[:, k:]


def lpc_restore_rows(r: np.ndarray, sizes: np.ndarray, coeffs: np.ndarray, orders: np.ndarray, shifts: np.ndarray, _: np.ndarray) -> np.ndarray:
    """Rows of residuals to samples: the sum of coefficients times the samples before, shifted right arithmetically, is added to each."""
    k = coeffs.shape[1]
    y = np.concatenate((np.zeros((len(r), k), np.int64), r.astype(np.int64)), axis=1)
    back = np.ascontiguousarray(coeffs[:, ::-1]).astype(np.int64)
    shift = shifts[:, 0].astype(np.int64)
    for t in range(r.shape[1]):
        live = t >= orders  # the first samples of a frame stand as they are
        y[:, k + t] += np.where(live, (y[:, t : k + t] * back).sum(axis=1) >> shift, 0)
    return y[:, k:]


def lpc_restore(df: DataFrame, residual: str = "r", coeffs: str = "coeffs", shift: str = "shift", out: str = "s") -> DataFrame:
    """Frames (..., residual array, coeffs array<int>, shift int) -> (..., out array<long>): inverts linear prediction of up to 32 taps.

    The first coefficient is that of the sample just before; the first samples, as many as coefficients, are kept.
    The state is the last taps of a frame, so a frame takes what its samples take.
    """
    rows = df.withColumn(shift, F.array(F.col(shift).cast("int")))
    return along_frames(rows, [residual, coeffs, shift], lpc_restore_rows, out, "long")


def lpc_residual(samples: Column, coeffs: Column, shift: Column) -> Column:
    """What prediction leaves of a frame's samples (arrays): the forward step, free of feedback."""
    order = F.size(coeffs)

    def one(s, i):
        total = F.aggregate(F.transform(coeffs, lambda c, j: c.cast("long") * F.get(samples, (i - j - 1).cast("int")).cast("long")), F.lit(0).cast("long"), lambda a, v: a + v)
        return F.when(i < order, s.cast("long")).otherwise(s.cast("long") - F.call_function("shiftright", total, shift.cast("int")))

    return F.transform(samples, one)


# --------------------------------------------------------------------------- pitch comb filter
#: The three taps of each tap set of the comb filter, the least period, and the greatest.
COMB_TAPS = [[0.3066406250, 0.2170410156, 0.1296386719], [0.4638671875, 0.2680664062, 0.0], [0.7998046875, 0.1000976562, 0.0]]
LEAST_PERIOD, MOST_PERIOD = 15, 1024


def comb_frame(past: np.ndarray, x: np.ndarray, old: tuple[int, float, int], new: tuple[int, float, int], overlap: int) -> np.ndarray:
    """One frame's outputs: five taps around each lag of the output itself, from the old parameters to the new ones over ``overlap`` samples.

    Outputs that no lag reaches yet go together: so many at once as the shorter lag, less two.
    """
    m, n = len(past), len(x)
    y = np.concatenate((past, x.astype(np.float64)))
    sets = [(max(p, LEAST_PERIOD), g * np.array(COMB_TAPS[t])) for p, g, t in (old, new)]
    i = np.arange(min(overlap, n))
    fade = np.ones(n)
    fade[: len(i)] = np.sin(np.pi / 2 * np.sin(np.pi / 2 * (i + 0.5) / overlap) ** 2) ** 2 if overlap else 1.0
    step = min(sets[0][0], sets[1][0]) - 2
    for a in range(0, n, step):
        z = min(a + step, n)
        add = np.zeros(z - a)
        for (lag, g), part in zip(sets, (1 - fade[a:z], fade[a:z]), strict=True):
            if g.any() and part.any():
                at = lambda d, lag=lag: y[m + a - lag + d : m + z - lag + d]  # noqa: E731, B023
                add += part * (g[0] * at(0) + g[1] * (at(1) + at(-1)) + g[2] * (at(2) + at(-2)))
        y[m + a : m + z] += add
    return y[m:]


def comb_filter(df: DataFrame, params: DataFrame, size: int, overlap: int = 120) -> DataFrame:
    """(stream_id, n, x) and (stream_id, frame, period, gain, tapset), frames of ``size`` samples -> (stream_id, n, y).

    Frames depend on those before, as far back as the greatest period; a task hands the last outputs from frame to frame. Where a
    stream's gains are 0 for that long, its outputs are its samples, so what follows is a chain of its own.
    """
    keep = MOST_PERIOD + 2
    reach = -(-keep // size)
    sid = df.schema["stream_id"].dataType.simpleString()
    listed = df.groupBy("stream_id", F.floor(F.col("n") / size).alias("frame")).agg(F.array_sort(F.collect_list(F.struct("n", F.col("x").cast("double").alias("x")))).alias("each"))
    frames = listed.select("stream_id", "frame", F.transform("each", lambda v: v["x"]).alias("x")).join(params.select("stream_id", "frame", "period", "gain", "tapset"), ["stream_id", "frame"])
    light = params.select("stream_id", "frame", "period", "gain", "tapset")
    before = previous(light, ["stream_id"], "frame", ["period", "gain", "tapset"])
    none = F.coalesce(F.col("prev_gain"), F.lit(0.0))
    marked = before.withColumn("loud", F.when((F.col("gain") != 0) | (none != 0), F.col("frame")))
    # a chain starts where the last loud frame lies more than ``reach`` frames back
    last = previous(carry(marked, ["stream_id"], "frame", "loud", "upto"), ["stream_id"], "frame", ["upto"])
    begins = last.withColumn("begin", F.when(F.col("loud").isNotNull() & (F.col("prev_upto").isNull() | (F.col("frame") - F.col("prev_upto") > reach)), F.col("frame")))
    chained = carry(begins, ["stream_id"], "frame", "begin", "chain").select("stream_id", "frame", "chain", "prev_period", "prev_gain", "prev_tapset", F.coalesce(F.col("frame") - F.col("upto") > reach, F.lit(True)).alias("idle"))
    joined = frames.join(chained, ["stream_id", "frame"])
    # frames far from any loud one pass as they are; the few before a chain come along as its past
    work = joined.filter("NOT idle").select("stream_id", "chain", "frame", F.lit(False).alias("past"), "x", "period", "gain", "tapset", "prev_period", "prev_gain", "prev_tapset")
    heads = begins.filter("begin IS NOT NULL").select("stream_id", F.col("begin").alias("chain"), F.explode(F.sequence(F.col("begin") - reach, F.col("begin") - 1)).alias("frame"))
    past = heads.join(frames.select("stream_id", "frame", "x"), ["stream_id", "frame"]).select("stream_id", "chain", "frame", F.lit(True).alias("past"), "x", *[F.lit(None).cast(t).alias(c) for c, t in (("period", "int"), ("gain", "double"), ("tapset", "int"), ("prev_period", "int"), ("prev_gain", "double"), ("prev_tapset", "int"))])
    order = ["stream_id", "chain", "frame"]
    ready = work.unionByName(past).repartition("stream_id", "chain").sortWithinPartitions(*order)

    def run(rows):
        key, tail = None, np.zeros(keep)
        for b in rows:
            out, at = [], []
            cols = [b.column(i).to_pylist() if i != 4 else b.column(i) for i in range(b.num_columns)]
            for i in range(b.num_rows):
                if (cols[0][i], cols[1][i]) != key:
                    key, tail = (cols[0][i], cols[1][i]), np.zeros(keep)
                x = np.asarray(cols[4][i].values)
                if not cols[3][i]:
                    new = (cols[5][i], cols[6][i], cols[7][i])
                    old = (cols[8][i] or 0, cols[9][i] or 0.0, cols[10][i] or 0)
                    if new[1] or old[1]:
                        x = comb_frame(tail, x, old, new, 0 if old == new else overlap)
                    out.append(x)
                    at.append(i)
                tail = np.concatenate((tail, x))[-keep:]
            if at:
                sizes = np.concatenate(([0], np.cumsum([len(v) for v in out]))).astype(np.int32)
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(2).take(take), pa.ListArray.from_arrays(sizes, pa.array(np.concatenate(out)))], names=["stream_id", "frame", "y"])

    made = ready.mapInArrow(run, f"stream_id {sid}, frame long, y array<double>").unionByName(joined.filter("idle").select("stream_id", "frame", F.col("x").alias("y")))
    rows = made.select("stream_id", "frame", F.posexplode("y").alias("i", "y"))
    return rows.select("stream_id", (F.col("frame") * size + F.col("i")).alias("n"), "y")
