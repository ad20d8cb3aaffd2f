"""Masking and bit allocation of a frame's bands, floor points, quantiser resolutions and code tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonaril.functions.fixed import _quotient

# Hearing threshold of each band at 48, 44.1 and 32 kHz.
HEARING = [
    (1232, 1264, 1408), (1232, 1264, 1408), (1088, 1120, 1200), (1024, 1040, 1104), (992, 992, 1056), (960, 976, 1008), (944, 960, 992), (944, 944, 976), (928, 944, 960), (928, 928, 944),
    (928, 928, 944), (928, 928, 944), (928, 928, 928), (912, 928, 928), (912, 912, 928), (912, 912, 928), (896, 912, 928), (896, 896, 928), (880, 896, 928), (880, 896, 928),
    (864, 880, 912), (864, 880, 912), (848, 864, 912), (848, 864, 912), (832, 848, 896), (832, 848, 896), (816, 832, 896), (800, 832, 880), (784, 800, 864), (768, 784, 848),
    (752, 768, 832), (752, 752, 816), (752, 752, 800), (752, 752, 784), (768, 752, 768), (784, 768, 752), (832, 800, 752), (912, 848, 752), (992, 912, 768), (1056, 992, 784),
    (1120, 1056, 816), (1168, 1104, 848), (1184, 1184, 960), (1120, 1168, 1040), (1088, 1120, 1136), (1088, 1088, 1184), (1312, 1152, 1120), (2048, 1584, 1088), (2112, 2112, 1104), (2112, 2112, 1248),
]
# Bits of a mantissa by its distance from the mask, in steps of 32.
POINTERS = [0, 1, 1, 1, 1, 1, 2, 2, 3, 3, 3, 4, 4, 5, 5, 6, 6, 6, 6, 7, 7, 7, 7, 8, 8, 8, 8, 9, 9, 9, 9, 10, 10, 10, 10, 11, 11, 11, 11, 12, 12, 12, 12, 13, 13, 13, 13, 14, 14, 14, 14, 14, 14, 14, 14, 15, 15, 15, 15, 15, 15, 15, 15, 15]
# 2^14 times powers of 2^(1/8).
EIGHTHS = [16384, 17866, 19483, 21247, 23170, 25267, 27554, 30048]


def masking_curve(df: DataFrame, fast_gain: int, slow_gain: int, fast_decay: int, slow_decay: int, knee: int, rate: int = 0) -> DataFrame:
    """(frame, psd array<int>) of a full-bandwidth channel's bands -> also ``mask``: what a leaky excitation and the hearing threshold hide.

    An ordered fold: the two leaks, the low-frequency correction and whether the leaks have begun go from band to band.
    """

    def low(a: Column, p: Column, after: Column, c: int) -> Column:
        return F.when(p + 256 == after, c).when(p > after, F.greatest(a - 64, F.lit(0))).otherwise(a)

    band = F.transform("psd", lambda p, i: F.struct(i.alias("b"), p.alias("p"), F.coalesce(F.get("psd", i + 1), F.lit(0)).alias("after")))
    start = F.struct(F.lit(0).alias("low"), F.lit(0).alias("fast"), F.lit(0).alias("slow"), F.lit(False).alias("begun"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        b, p, after = x["b"], x["p"], x["after"]
        first, rise = b < 2, (b < 7) & ~s["begun"]
        lowest = F.when((b < 7), low(s["low"], p, after, 384)).when(b < 20, low(s["low"], p, after, 320)).when(b < 22, F.greatest(s["low"] - 128, F.lit(0))).otherwise(s["low"])
        fast = F.when(rise, p - fast_gain).otherwise(F.greatest(s["fast"] - fast_decay, p - fast_gain))
        slow = F.when(rise, p - slow_gain).otherwise(F.greatest(s["slow"] - slow_decay, p - slow_gain))
        excited = F.when(rise, fast - lowest).when(b < 22, F.greatest(fast - lowest, slow)).otherwise(F.greatest(fast, slow))
        begun = s["begun"] | (~first & (p <= after)) | (b >= 6)
        return F.struct(lowest.alias("low"), fast.alias("fast"), slow.alias("slow"), begun.alias("begun"), F.concat(s["out"], F.array(excited.cast("int"))).alias("out"))

    excitation = F.aggregate(band, start, step, lambda s: s["out"])
    hearing = F.array(*[F.lit(h[rate]) for h in HEARING])
    deep = lambda p: F.greatest(F.lit(knee) - p, F.lit(0))
    mask = F.transform(F.arrays_zip(excitation.alias("e"), F.col("psd").alias("p")), lambda x, i: F.greatest(F.get(hearing, i), x["e"] + F.shiftright(deep(x["p"]), 2)))
    return df.withColumn("mask", mask)


def allocation(df: DataFrame, snr: int, floor: int) -> DataFrame:
    """(frame, band, k, psd, mask) lines -> also ``pointer``: the mantissa's resolution by its distance from the mask."""
    m = F.greatest(F.col("mask") - snr - floor, F.lit(0)).bitwiseAND(0x1FE0) + floor
    at = F.greatest(F.lit(0), F.least(F.lit(63), F.shiftright(F.col("psd") - m, 5)))
    return df.withColumn("pointer", F.get(F.array(*map(F.lit, POINTERS)), at))


def angle_steps(n: Column, bits: Column, offset: Column, cap: Column, stereo: Column) -> Column:
    """Quantiser steps of a split's angle by the bits (in eighths) that a band of n lines has; even, and 1 where they don't suffice."""
    parts = 2 * n - 1 - F.when(stereo & (n == 2), 1).otherwise(0)
    q = _quotient((bits + parts * offset).cast("long"), parts.cast("long"))
    q = F.least(F.least(bits - cap - 32, q), F.lit(64))
    shift = (14 - F.shiftright(q, 3)).cast("int")
    steps = F.call_function("shiftright", F.get(F.array(*map(F.lit, EIGHTHS)), q.bitwiseAND(7).cast("int")), F.greatest(shift, F.lit(0)))
    return F.when(q < 4, 1).otherwise(F.shiftright(steps + 1, 1) * 2).cast("int")


def floor_points(df: DataFrame, xs: list[int], top: int) -> DataFrame:
    """(frame, y array<int>) differences at the points ``xs`` (their order of placing) -> also (level, used): each point's level and whether it bends the curve.

    A point is predicted on the line between its nearest placed neighbours; the difference counts up and down from
    there while there is room on both sides, and then on one.
    """
    level = [F.get("y", F.lit(0)).cast("long"), F.get("y", F.lit(1)).cast("long")]
    out, used = df, [[F.lit(True)], [F.lit(True)]]
    out = out.withColumn("_l0", level[0]).withColumn("_l1", level[1])
    for i in range(2, len(xs)):
        low = max((k for k in range(i) if xs[k] < xs[i]), key=lambda k: xs[k])
        high = min((k for k in range(i) if xs[k] > xs[i]), key=lambda k: xs[k])
        a, b = F.col(f"_l{low}"), F.col(f"_l{high}")
        p = a + _quotient((b - a) * (xs[i] - xs[low]), F.lit(xs[high] - xs[low]).cast("long"))
        d = F.get("y", F.lit(i)).cast("long")
        above, room = top - p, 2 * F.least(top - p, p)
        far = F.when(above > p, d).otherwise(p + above - d - 1)
        near = F.when(d % 2 == 1, p - F.floor((d + 1) / 2)).otherwise(p + F.floor(d / 2))
        out = out.withColumn(f"_l{i}", F.when(d == 0, p).when(d >= room, far).otherwise(near).cast("long"))
        used.append([d != 0])
        used[low].append(d != 0)
        used[high].append(d != 0)
    clipped = F.array(*[F.greatest(F.lit(0), F.least(F.lit(top - 1), F.col(f"_l{i}"))).cast("int") for i in range(len(xs))])
    flags = F.array(*[F.array_max(F.array(*u)) for u in used])
    return out.withColumn("level", clipped).withColumn("used", flags).drop(*[f"_l{i}" for i in range(len(xs))])


def canonical_codes(lengths: DataFrame, longest: int = 32) -> DataFrame:
    """(book, symbol, length) -> also (code, key): code words in order of length and symbol, and each with its leading one as one number."""
    before = Window.partitionBy("book").orderBy("length", "symbol").rowsBetween(Window.unboundedPreceding, -1)
    used = F.call_function("shiftleft", F.lit(1).cast("long"), (F.lit(longest) - F.col("length")).cast("int"))
    ahead = F.coalesce(F.sum(used).over(before), F.lit(0))
    code = F.call_function("shiftright", ahead, (F.lit(longest) - F.col("length")).cast("int"))
    return lengths.withColumn("code", code).withColumn("key", F.call_function("shiftleft", F.lit(1).cast("long"), F.col("length").cast("int")) + F.col("code"))


def look_up(codes: DataFrame, table: DataFrame) -> DataFrame:
    """(book, length, code) met with a code table (book, symbol, key): the symbol of each code, null where the book has none."""
    key = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("length").cast("int")) + F.col("code")
    return codes.withColumn("key", key).join(table.select("book", "key", "symbol"), ["book", "key"], "left").drop("key")


def fill_noise(df: DataFrame, seed: int, energy: Column | float = 1.0) -> DataFrame:
    """(frame, band, k, draw): lines of a band as random numbers of the given energy; a line's draw follows from its running number."""
    from sonaril.functions.fixed import lcg_jump, wrap32

    x = wrap32(lcg_jump(seed, F.col("draw"))).cast("double")
    total = F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("frame", "band"))
    drawn = df.withColumn("x", x)
    return drawn.withColumn("x", F.col("x") * ((F.lit(energy) if isinstance(energy, float) else energy) / F.sqrt(total)))
