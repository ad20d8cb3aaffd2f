"""Spectral stages: bands, butterflies, transforms, windows and overlap, as joins with small fixed tables."""

from __future__ import annotations

import math
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonaril.operators.ordering import BLOCK, previous, running_sum
from sonaril.operators.recurrence import all_pole_rows, along_frames

# Scale factor band edges (long blocks, 44.1 kHz), pre-emphasis by band, butterfly terms.
LONG_44 = [0, 4, 8, 12, 16, 20, 24, 30, 36, 44, 52, 62, 74, 90, 110, 134, 162, 196, 238, 288, 342, 418, 576]
SHORT_44 = [0, 4, 8, 12, 16, 22, 30, 40, 52, 66, 84, 106, 136, 192]
PRETAB = [0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 1, 1, 1, 2, 2, 3, 3, 3, 2, 0]
BUTTERFLY = [-0.6, -0.535, -0.33, -0.185, -0.095, -0.041, -0.0142, -0.0037]


def band_table(spark: SparkSession, edges: list[int]) -> DataFrame:
    """(k, band): every line's band, so the interval join is an equality with a fixed table."""
    rows = [(k, b) for b in range(len(edges) - 1) for k in range(edges[b], edges[b + 1])]
    return spark.createDataFrame(rows, "k int, band int")


def butterfly_terms() -> list[tuple[float, float]]:
    """cs and ca of the eight butterflies: 1 / sqrt(1 + c^2) and c / sqrt(1 + c^2), to nine places."""
    return [(round(1 / math.sqrt(1 + c * c), 9), round(c / math.sqrt(1 + c * c), 9)) for c in BUTTERFLY]


def requantize(df: DataFrame, edges: list[int] = LONG_44) -> DataFrame:
    """(frame, k, q, global_gain, scale, preflag, sf map by band) lines to amplitudes.

    sign(q) |q|^(4/3) 2^((gain - 210) / 4) 2^(-multiplier (sf + preflag * pretab)); q beyond 8206 counts as 8206.
    """
    spark = df.sparkSession
    pre = spark.createDataFrame(list(enumerate(PRETAB)), "band int, pre int")
    dim = F.broadcast(band_table(spark, edges).join(pre, "band"))  # one row per line
    mult = F.when(F.col("scale") == 0, 0.5).otherwise(1.0)
    sf = F.coalesce(F.get(F.col("sf"), F.col("band")), F.lit(0))
    mag = F.pow(F.least(F.abs("q"), F.lit(8206)).cast("double"), F.lit(4.0 / 3.0))
    x = F.signum(F.col("q").cast("double")) * mag * F.pow(F.lit(2.0), (F.col("global_gain") - 210) * 0.25) * F.pow(F.lit(2.0), -mult * (sf + F.col("preflag") * F.col("pre")))
    return df.join(dim, "k").select("frame", "k", "band", x.alias("x"))


def antialias(df: DataFrame, bands: int) -> DataFrame:
    """(frame, k, x): eight butterflies at each boundary of 18 lines; lines meet by (frame, boundary, i)."""
    spark = df.sparkSession
    terms = spark.createDataFrame([(i, cs, ca) for i, (cs, ca) in enumerate(butterfly_terms())], "i int, cs double, ca double")
    rows = []
    for sb in range(1, bands):
        rows += [(18 * sb - 1 - i, sb, i, 0) for i in range(8)] + [(18 * sb + i, sb, i, 1) for i in range(8)]
    sides = F.broadcast(spark.createDataFrame(rows, "k int, sb int, i int, upper int").join(terms, "i"))
    mark = df.join(sides, "k", "left")
    pair = Window.partitionBy("frame", "sb", "i")
    other = F.sum("x").over(pair) - F.col("x")
    both = mark.filter("sb IS NOT NULL").withColumn("y", F.when(F.col("upper") == 0, F.col("x") * F.col("cs") - other * F.col("ca")).otherwise(F.col("x") * F.col("cs") + other * F.col("ca")))
    return both.select("frame", "k", F.col("y").alias("x")).unionByName(mark.filter("sb IS NULL").select("frame", "k", "x"))


def invert_frequencies(df: DataFrame) -> DataFrame:
    """Negate odd lines of odd subbands of 18."""
    odd = (F.floor(F.col("k") / 18) % 2 == 1) & ((F.col("k") % 18) % 2 == 1)
    return df.withColumn("x", F.when(odd, -F.col("x")).otherwise(F.col("x")))


def reorder_short(df: DataFrame, edges: list[int] = SHORT_44) -> DataFrame:
    """(frame, k, x): window-major lines of short blocks to line-major, by a fixed permutation."""
    rows = []
    for b in range(len(edges) - 1):
        n, base = edges[b + 1] - edges[b], 3 * edges[b]
        rows += [(base + w * n + j, base + 3 * j + w) for w in range(3) for j in range(n)]
    dim = F.broadcast(df.sparkSession.createDataFrame(rows, "k int, k2 int"))
    return df.join(dim, "k").select("frame", F.col("k2").alias("k"), "x")


def _transform(df: DataFrame, by: list[str], make, lines: int, line: str = "k", where: str = "i", value: str = "y") -> DataFrame:
    """Lines (by..., line, x) -> (by..., where, value): each key's lines come together once and go through a fixed linear map.

    ``make``, called in the task, gives the map: a matrix (lines x outputs), or a function of rows of lines.
    """
    import numpy as np
    import pyarrow as pa

    g = df.filter("x <> 0").groupBy(*by).agg(F.collect_list(F.struct(F.col(line).cast("int").alias("k"), "x")).alias("v"))  # zero lines add nothing
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)

    def run(batches):
        through = make()
        rows = max(1, (1 << 20) // lines)
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                b = whole.slice(at, rows)
                lists = b.column(len(by))
                flat = lists.flatten()
                x = np.zeros((b.num_rows, lines))
                np.add.at(x, (np.repeat(np.arange(b.num_rows), np.asarray(lists.value_lengths())), np.asarray(flat.field("k"))), np.asarray(flat.field("x")))
                y = through(x) if callable(through) else x @ through
                ends = pa.array(np.arange(0, y.size + 1, y.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([*b.columns[: len(by)], pa.ListArray.from_arrays(ends, pa.array(y.ravel()))], names=[*by, "y"])

    return g.mapInArrow(run, f"{kinds}, y array<double>").select(*by, F.posexplode("y").alias(where, value))


def imdct_basis(n: int):
    """cos(2 pi / n (i + 1/2 + n/4) (k + 1/2)) for k < n / 2, i < n."""
    import numpy as np

    k, i = np.arange(n // 2)[:, None], np.arange(n)[None, :]
    return np.cos(2 * math.pi / n * (i + 0.5 + n / 4) * (k + 0.5))


def fast_imdct(n: int):
    """The same map by a complex Fourier transform of n / 4 points: lines in pairs from both ends, turned before and after, unfolded to n samples."""
    import numpy as np

    half, quarter = n // 2, n // 4
    turn = np.exp(-1j * math.pi / (8 * half) * (8 * np.arange(quarter) + 1))
    at = np.arange(n) + quarter  # which of the half samples, by their symmetries, and its sign
    sign = np.where(at < half, 1.0, -1.0)
    at = np.where(at < half, at, np.where(at < n, n - 1 - at, at - n))

    def through(x):
        z = np.fft.fft((x[:, ::2] + 1j * x[:, ::-1][:, ::2]) * turn, axis=1) * turn
        u = np.empty_like(x)
        u[:, ::2], u[:, ::-1][:, ::2] = z.real, -z.imag
        return u[:, at] * sign

    return through


#: up to so many samples a block, a product with the matrix is as fast
DENSE = 256


def imdct_map(n: int):
    return imdct_basis(n) if n <= DENSE else fast_imdct(n)


def imdct(df: DataFrame, n: int) -> DataFrame:
    """(frame, k, x), k < n / 2 -> (frame, i, y), i < n: y_i = sum of x_k cos(2 pi / n (i + 1/2 + n/4) (k + 1/2)); n is a multiple of 4."""
    return _transform(df, ["frame"], partial(imdct_map, n), n // 2)


def basis36(block_type: int):
    import numpy as np

    m, p = np.arange(18)[:, None], np.arange(36)[None, :]
    return np.cos(math.pi / 72 * (2 * p + 1 + 18) * (2 * m + 1)) * np.array(block_window(block_type))[None, :]


def imdct36(df: DataFrame, block_type: int = 0) -> DataFrame:
    """(frame, sb, m, x), m < 18 -> (frame, sb, i, y), i < 36, windowed for a long block type."""
    return _transform(df, ["frame", "sb"], partial(basis36, block_type), 18, "m")


def basis12():
    import numpy as np

    basis, win = np.zeros((18, 36)), block_window(2)
    for w in range(3):
        for m in range(6):
            for p in range(12):
                basis[w + 3 * m, 6 * w + p + 6] += math.cos(math.pi / 24 * (2 * p + 1 + 6) * (2 * m + 1)) * win[p]
    return basis


def imdct12(df: DataFrame) -> DataFrame:
    """(frame, sb, m, x), m < 18 -> (frame, sb, i, y), i < 36, for short blocks: three windowed transforms of every third line, laid 6 apart."""
    return _transform(df, ["frame", "sb"], basis12, 18, "m")


def hybrid_overlap(df: DataFrame) -> DataFrame:
    """(stream_id, frame, sb, i, y), i < 36 -> (stream_id, frame, sb, i, y), i < 18: first half plus the last granule's second, in every subband."""
    late = F.col("i") >= 18
    parts = df.select("stream_id", (F.col("frame") + late.cast("int")).alias("frame"), "sb", (F.col("i") % 18).alias("i"), "y", late.alias("late"))
    return parts.groupBy("stream_id", "frame", "sb", "i").agg(F.sum("y").alias("y"), F.count_if(~F.col("late")).alias("own")).filter("own = 1").drop("own")


def synthesis_window(df: DataFrame, window: list[float]) -> DataFrame:
    """(stream_id, step, i, v), i < 64 -> (stream_id, step, j, y), j < 32: the 16 last steps under a window of 512.

    Even steps back give their first half, odd ones their second, each to the output that is so many steps on; so the
    queue is one sum, with partial aggregation.
    """
    even = [(j, 2 * m, j, float(window[64 * m + j])) for m in range(8) for j in range(32)]
    odd = [(32 + j, 2 * m + 1, j, float(window[64 * m + 32 + j])) for m in range(8) for j in range(32)]
    taps = F.broadcast(df.sparkSession.createDataFrame(even + odd, "i int, back int, j int, w double"))  # 512 rows
    ends = df.groupBy("stream_id").agg(F.max("step").alias("_end"))
    live = df.join(taps, "i").withColumn("step", F.col("step") + F.col("back")).groupBy("stream_id", "step", "j").agg(F.sum(F.col("v") * F.col("w")).alias("y"))
    return live.join(ends, "stream_id").filter(F.col("step") <= F.col("_end")).drop("_end")


def block_window(block_type: int) -> list[float]:
    """36-sample windows: 0 normal, 1 start, 3 stop; 2 has 12 samples."""
    s = lambda den, i: math.sin(math.pi / den * (i + 0.5))
    if block_type == 0:
        return [s(36, i) for i in range(36)]
    if block_type == 1:
        return [s(36, i) for i in range(18)] + [1.0] * 6 + [s(12, i - 18) for i in range(24, 30)] + [0.0] * 6
    if block_type == 2:
        return [s(12, i) for i in range(12)]
    return [0.0] * 6 + [s(12, i - 6) for i in range(6, 12)] + [1.0] * 6 + [s(36, i) for i in range(18, 36)]


def kbd_window(n: int, alpha: float, terms: int = 50) -> list[float]:
    """Rising half of a Kaiser-Bessel derived window of n samples."""

    def i0(x: float) -> float:
        total = term = 1.0
        for k in range(1, terms):
            term *= (x / 2 / k) ** 2
            total += term
        return total

    half = n // 2
    w = [i0(math.pi * alpha * math.sqrt(1 - (2 * i / half - 1) ** 2)) for i in range(half + 1)]
    total, run, out = sum(w), 0.0, []
    for i in range(half):
        run += w[i]
        out.append(math.sqrt(run / total))
    return out


def vorbis_slope(n: int) -> list[float]:
    """Rising slope of n samples: sin(pi/2 sin^2(pi/2 (i + 1/2) / n))."""
    return [math.sin(math.pi / 2 * math.sin(math.pi / 2 * (i + 0.5) / n) ** 2) for i in range(n)]


def vorbis_window(n: int, short: int, long_block: bool, prev_long: bool, next_long: bool) -> list[float]:
    """Window of one block: short slopes, flat between, where a long block has a short neighbour."""
    left = short if long_block and not prev_long else n
    right = short if long_block and not next_long else n
    out = [0.0] * n
    lo, hi = n // 4 - left // 4, 3 * n // 4 - right // 4
    up, down = vorbis_slope(left // 2), vorbis_slope(right // 2)
    for i in range(n):
        if lo <= i < lo + left // 2:
            out[i] = up[i - lo]
        elif lo + left // 2 <= i < hi:
            out[i] = 1.0
        elif hi <= i < hi + right // 2:
            out[i] = down[right // 2 - 1 - (i - hi)]
    return out


def apply_window(df: DataFrame, window: list[float], at: str = "i", value: str = "y") -> DataFrame:
    dim = F.broadcast(df.sparkSession.createDataFrame([(i, float(v)) for i, v in enumerate(window)], f"{at} int, _w double"))
    return df.join(dim, at).withColumn(value, F.col(value) * F.col("_w")).drop("_w")


def overlap_add(df: DataFrame, n: int) -> DataFrame:
    """(frame, i, y) blocks of n with consecutive frames -> (frame, i, y), i < n / 2: first half plus the last block's second.

    Each half is keyed by the output block it belongs to, so this is one sum, with partial aggregation.
    """
    half = n // 2
    late = F.col("i") >= half
    parts = df.select((F.col("frame") + late.cast("int")).alias("frame"), (F.col("i") % half).alias("i"), "y", late.alias("late"))
    return parts.groupBy("frame", "i").agg(F.sum("y").alias("y"), F.count_if(~F.col("late")).alias("own")).filter("own = 1").select("frame", "i", "y")


def lap_variable(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """(stream_id, block, n, y array<double>) with varying sizes -> (stream_id, pos, y): (prev + n) / 4 samples a block.

    A block's tail is laid over the next block's start, which begins (n - prev) / 4 into that block.
    """
    tails = df.withColumn("tail", F.expr("slice(y, n div 2 + 1, n - n div 2)"))
    b = previous(tails, ["stream_id"], "block", ["n", "tail"], block).filter("prev_n IS NOT NULL").drop("tail").withColumnRenamed("prev_tail", "tail")
    b = running_sum(b.withColumn("size", F.expr("(prev_n + n) div 4")), ["stream_id"], "block", "size", "base", exclusive=True, block=block)
    b = b.withColumn("off", F.expr("CAST(floor((n - prev_n) / 4) AS INT)"))
    rows = b.select("stream_id", "base", "tail", "y", "off", "n", F.explode(F.expr("sequence(0, CAST(size AS INT) - 1)")).alias("a"))
    tail = F.coalesce(F.get("tail", F.col("a")), F.lit(0.0))
    own = F.when((F.col("a") + F.col("off")).between(F.lit(0), F.col("n") - 1), F.get("y", F.col("a") + F.col("off"))).otherwise(0.0)
    return rows.select("stream_id", (F.col("base") + F.col("a")).alias("pos"), (tail + own).alias("y"))


def normalise_energy(df: DataFrame) -> DataFrame:
    """(frame, band, k, x): each band scaled to unit energy; silent bands stay 0."""
    e = F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("frame", "band"))
    return df.withColumn("x", F.when(e > 0, F.col("x") / F.sqrt(e)).otherwise(0.0))


def couple(df: DataFrame, coords: DataFrame) -> DataFrame:
    """Coupling lines (frame, band, k, x) times each channel's coordinate (frame, band, ch, coord)."""
    return df.join(coords, ["frame", "band"]).select("frame", "ch", "k", (F.col("x") * F.col("coord")).alias("x"))


def denormalise(df: DataFrame, energies: DataFrame) -> DataFrame:
    """Unit-energy shapes (frame, band, k, x) times 2^energy of their band (frame, band, e)."""
    return df.join(energies, ["frame", "band"]).select("frame", "k", (F.col("x") * F.pow(F.lit(2.0), F.col("e"))).alias("x"))


def haar(df: DataFrame) -> DataFrame:
    """(frame, k, x): neighbouring pairs to their scaled sum and difference."""
    pair = Window.partitionBy("frame", F.floor(F.col("k") / 2))
    total = F.sum("x").over(pair)
    even = F.col("k") % 2 == 0
    return df.withColumn("x", F.when(even, total).otherwise(total - 2 * F.col("x")) * F.lit(2.0**-0.5))


def subband_basis():
    import numpy as np

    k, i = np.arange(32)[:, None], np.arange(64)[None, :]
    return np.cos((16 + i) * (2 * k + 1) * math.pi / 64)


def polyphase_matrix(df: DataFrame) -> DataFrame:
    """(step, k, x), k < 32 subband samples -> (step, i, v), i < 64: cosine matrixing of a synthesis step."""
    return _transform(df, ["step"], subband_basis, 32, value="v")


def render_line(df: DataFrame) -> DataFrame:
    """(x0, y0, x1, y1) segments to integer points (x, y), x0 <= x < x1, truncating towards the start; none where x1 isn't beyond x0."""
    pts = df.filter("x1 > x0").withColumn("x", F.explode(F.expr("sequence(x0, x1 - 1)")))
    return pts.withColumn("y", F.expr("y0 + ((y1 - y0) * (x - x0)) div (x1 - x0)"))


# --------------------------------------------------------------------------- window sequences and block switching
def sine_window(n: int) -> list[float]:
    return [math.sin(math.pi / n * (i + 0.5)) for i in range(n)]


def long_window(sequence: str, current: list[float], before: list[float], short_current: list[float], short_before: list[float]) -> list[float]:
    """Window of a long-type block (``only``, ``start`` or ``stop``) from full long and short windows of the shape of this block and the last.

    A start block falls over a short slope, a stop block rises over one; both are flat beside it.
    """
    n, s = len(current) // 2, len(short_current) // 2
    flat = (n - s) // 2
    rise = [0.0] * flat + short_before[:s] + [1.0] * flat if sequence == "stop" else before[:n]
    fall = [1.0] * flat + short_current[s:] + [0.0] * flat if sequence == "start" else current[n:]
    return rise + fall


def window_sequence(df: DataFrame, windows: dict[str, list[float]]) -> DataFrame:
    """(frame, sequence, i, y) blocks under the window of their sequence."""
    rows = [(name, i, float(v)) for name, w in windows.items() for i, v in enumerate(w)]
    dim = F.broadcast(df.sparkSession.createDataFrame(rows, "sequence string, i int, _w double"))  # a row per sequence and sample
    return df.join(dim, ["sequence", "i"]).withColumn("y", F.col("y") * F.col("_w")).drop("_w")


def short_block_basis(n: int, short_window: list[float], before: list[float], count: int = 8):
    """Lines of ``count`` short transforms, window after window, to a long block of n samples: each windowed and laid a hop further."""
    import numpy as np

    size = len(short_window)
    half = size // 2
    one = imdct_basis(size)
    out = np.zeros((count * half, n))
    offset = n // 4 - half // 2
    for w in range(count):
        win = np.array((before if w == 0 else short_window)[:half] + short_window[half:])
        out[w * half : (w + 1) * half, offset + w * half : offset + w * half + size] += one * win[None, :]
    return out


def short_blocks(df: DataFrame, n: int, short_window: list[float], before: list[float] | None = None, count: int = 8) -> DataFrame:
    """(frame, k, x) window-major lines of ``count`` short blocks -> (frame, i, y), i < n, to be overlapped like a long block's."""
    return _transform(df, ["frame"], partial(short_block_basis, n, short_window, before or short_window, count), n // 2)


def switched_basis(n: int, switched: bool):
    """Lines to n samples at a scale of -2048 / n: one transform, or two of half the size from the even and the odd lines, end to end."""
    import numpy as np

    if not switched:
        return imdct_basis(n) * (-2048 / n)
    half, out = n // 2, np.zeros((n // 2, n))
    for odd in (0, 1):
        out[odd::2, odd * half : (odd + 1) * half] = imdct_basis(half) * (-2048 / half)
    return out


def switched_transform(df: DataFrame, n: int, window: list[float]) -> DataFrame:
    """(frame, switched, k, x) -> (frame, i, y), i < n: windowed blocks of either kind; ``window`` is the rising half."""
    both = [_transform(df.filter(F.col("switched") == on), ["frame"], partial(switched_basis, n, on), n // 2) for on in (False, True)]
    return apply_window(both[0].unionByName(both[1]), [*window, *reversed(window)])


# --------------------------------------------------------------------------- filters and permutations of a frame's lines
def step_up(parcor):
    """Reflection coefficients (an array) to those of the all-pole filter, as a fold: each step adds one and mirrors the others."""

    def step(lpc, r):
        mirrored = F.reverse(lpc)
        return F.concat(F.zip_with(lpc, mirrored, lambda f, b: f - r * b), F.array(-r))

    return F.aggregate(parcor, F.array().cast("array<double>"), step)


def shape_noise(df: DataFrame, backwards: bool = False) -> DataFrame:
    """(frame, x array<double>, parcor array<double>) -> x filtered by the all-pole filter of the reflection coefficients, up or down the lines."""
    turned = F.reverse("x") if backwards else F.col("x")
    ready = df.select(*[c for c in df.columns if c != "x"], turned.cast("array<double>").alias("x"), step_up(F.col("parcor")).alias("_lpc"))
    y = along_frames(ready, ["x", "_lpc"], all_pole_rows, "x", "double")
    return y.withColumn("x", F.reverse("x")) if backwards else y


def add_pulses(df: DataFrame, pulses: DataFrame) -> DataFrame:
    """(frame, k, x, scale) with pulses (frame, k, amp): |x|^(3/4) grows by the pulse, away from zero; a line of 0 takes -amp.

    ``scale`` is the band's factor; lines of bands with factor 0 keep their value.
    """
    both = df.join(pulses, ["frame", "k"], "left")
    co = F.try_divide("x", "scale")
    root = F.try_divide(co, F.sqrt(F.sqrt(F.abs(co))))
    sign = F.when(co > 0, 1.0).otherwise(-1.0)
    grown = F.when(F.col("x") == 0, -F.col("amp").cast("double")).otherwise(root + sign * F.col("amp"))
    out = F.pow(F.abs(grown), F.lit(1.0 / 3.0)) * grown * F.col("scale")
    return both.withColumn("x", F.when(F.col("amp").isNull() | (F.col("scale") == 0), F.col("x")).otherwise(out)).drop("amp")


def hadamard_order(stride: int) -> list[int]:
    """Where each of ``stride`` interleaved blocks goes: place j holds the bit-reversed Gray code of its distance from the last."""
    bits, out = stride.bit_length() - 1, [0] * stride
    for j in range(stride):
        g = (stride - 1 - j) ^ (stride - 1 - j) >> 1
        out[int(f"{g:0{bits}b}"[::-1], 2) if bits else 0] = j
    return out


def deinterleave(df: DataFrame, stride: int, order: list[int] | None = None) -> DataFrame:
    """(frame, k, x): lines interleaved from ``stride`` blocks of a frame to block after block, in the given order."""
    n = F.max("k").over(Window.partitionBy("frame")) + 1
    at = F.col("k") % stride
    place = F.get(F.array(*map(F.lit, order)), at) if order else at
    moved = place * F.floor(F.col("_n") / stride) + F.floor(F.col("k") / stride)
    return df.withColumn("_n", n).withColumn("k", moved.cast("int")).drop("_n")


def split_channels(df: DataFrame) -> DataFrame:
    """Two spectra (columns c0, c1) to their scaled sum and difference (second less first)."""
    h = 2.0**-0.5
    return df.withColumn("l", (F.col("c0") + F.col("c1")) * h).withColumn("r", (F.col("c1") - F.col("c0")) * h).drop("c0", "c1")


def merge_channels(df: DataFrame, mid: float) -> DataFrame:
    """(frame, k, c0, c1) middle and side shapes -> unit-energy left and right; where one would vanish, both are the middle."""
    w = Window.partitionBy("frame")
    cross, side = mid * F.sum(F.col("c0") * F.col("c1")).over(w), F.sum(F.col("c1") * F.col("c1")).over(w)
    left, right = mid * mid + side - 2 * cross, mid * mid + side + 2 * cross
    thin = (left < 6e-4) | (right < 6e-4)
    l = F.when(thin, F.col("c0")).otherwise((mid * F.col("c0") - F.col("c1")) / F.sqrt(left))
    r = F.when(thin, F.col("c0")).otherwise((mid * F.col("c0") + F.col("c1")) / F.sqrt(right))
    return df.withColumn("l", l).withColumn("r", r).drop("c0", "c1")


def collapse_masks(df: DataFrame, blocks: int) -> DataFrame:
    """(frame, band, k, q) pulses, k within the band -> (frame, band, mask): bit b is set where block b of the band has any."""
    size = F.count("*").over(Window.partitionBy("frame", "band"))
    b = F.floor(F.col("k") / F.floor(F.col("_n") / blocks)).cast("int")
    bit = F.when((F.col("q") != 0) & (b < blocks), F.call_function("shiftleft", F.lit(1), b)).otherwise(0)
    return df.withColumn("_n", size).groupBy("frame", "band").agg(F.bit_or(bit).alias("mask"))


def drop_dither(df: DataFrame, dithered) -> DataFrame:
    """(frame, ch, k, x, bits): coupled lines without bits become 0 in channels that want no noise."""
    return df.withColumn("x", F.when((F.col("bits") == 0) & ~dithered, 0.0).otherwise(F.col("x")))
