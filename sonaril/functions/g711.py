"""G.711 companding of one sample as integer expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sonaril.functions.pcm import col

# Fixed values of the standard.
MU_CLIP, MU_BIAS = 32635, 132
MU_OFFSETS = (0, 132, 396, 924, 1980, 4092, 8316, 16764)


def _floor_log2(x: Column, bits: int) -> Column:
    """Position of the highest set bit of 0 <= x < 2**bits; 0 for x = 0."""
    out = F.lit(0)
    for k in range(1, bits):
        out = out + (x >= (1 << k)).cast("int")
    return out


def _shift_right(x: Column, n: Column) -> Column:
    return F.floor(x / F.pow(F.lit(2.0), n)).cast("int")


def mulaw_encode(s: Column | str) -> Column:
    s = col(s).cast("int")
    m = F.least(F.lit(MU_CLIP), F.abs(s)) + MU_BIAS
    exp = _floor_log2(F.shiftright(m, 7).bitwiseAND(255), 8)
    mant = _shift_right(m, exp + 3).bitwiseAND(15)
    sign = F.when(s < 0, 128).otherwise(0)
    return (255 - (sign + exp * 16 + mant)).cast("int")


def mulaw_decode(code: Column | str) -> Column:
    u = 255 - col(code).cast("int")
    exp = F.shiftright(u, 4).bitwiseAND(7)
    mag = F.element_at(F.array(*map(F.lit, MU_OFFSETS)), exp + 1) + u.bitwiseAND(15) * F.pow(F.lit(2), exp + 3).cast("int")
    return F.when(u >= 128, -mag).otherwise(mag).cast("int")


def alaw_encode(s: Column | str) -> Column:
    v = F.shiftright(col(s).cast("int"), 3)
    mask = F.when(v >= 0, 0xD5).otherwise(0x55)
    v = F.when(v >= 0, v).otherwise(-v - 1)
    seg = F.when(v < 32, 0).otherwise(F.least(F.lit(7), _floor_log2(F.shiftright(v, 5), 8) + 1))
    mant = F.when(seg < 2, F.shiftright(v, 1)).otherwise(_shift_right(v, seg)).bitwiseAND(15)
    return (seg * 16 + mant).bitwiseXOR(mask).bitwiseAND(255).cast("int")


def alaw_decode(code: Column | str) -> Column:
    a = col(code).cast("int").bitwiseXOR(F.lit(0x55))
    t = a.bitwiseAND(15) * 16
    seg = F.shiftright(a.bitwiseAND(0x70), 4)
    t = F.when(seg == 0, t + 8).when(seg == 1, t + 0x108).otherwise((t + 0x108) * F.pow(F.lit(2), seg - 1).cast("int"))
    return F.when(a.bitwiseAND(0x80) == 0, -t).otherwise(t).cast("int")
