"""Fixed-point helpers as wide-integer expressions, and random number generators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sonaril.functions.bits import ilog
from sonaril.functions.pcm import col

U32 = 0xFFFFFFFF


def _long(x: Column | str | int) -> Column:
    return F.lit(x).cast("long") if isinstance(x, int) else col(x).cast("long")


def wrap16(x: Column | str) -> Column:
    low = _long(x).bitwiseAND(F.lit(0xFFFF))
    return F.when(low >= 32768, low - 65536).otherwise(low)


def wrap32(x: Column | str) -> Column:
    low = _long(x).bitwiseAND(F.lit(U32))
    return F.when(low >= 1 << 31, low - (1 << 32)).otherwise(low)


def saturate32(x: Column | str) -> Column:
    return F.greatest(F.lit(-(1 << 31)).cast("long"), F.least(F.lit((1 << 31) - 1).cast("long"), _long(x)))


def smulwb(a: Column | str, b: Column | str) -> Column:
    return F.shiftright(_long(a) * wrap16(b), 16)


def smlawb(a: Column | str, b: Column | str, c: Column | str) -> Column:
    return _long(a) + smulwb(b, c)


def smulbb(a: Column | str, b: Column | str) -> Column:
    return wrap16(a) * wrap16(b)


def smulww(a: Column | str, b: Column | str) -> Column:
    """32 by 32 bits; the product stays within 63 bits."""
    return F.shiftright(_long(a) * _long(b), 16)


def smmul(a: Column | str, b: Column | str) -> Column:
    return F.shiftright(_long(a) * _long(b), 32)


def smlaww(a: Column | str, b: Column | str, c: Column | str) -> Column:
    return _long(a) + smulww(b, c)


def smlabb(a: Column | str, b: Column | str, c: Column | str) -> Column:
    return _long(a) + smulbb(b, c)


def saturate16(x: Column | str) -> Column:
    return F.greatest(F.lit(-32768).cast("long"), F.least(F.lit(32767).cast("long"), _long(x)))


def add_sat32(a: Column | str, b: Column | str) -> Column:
    return saturate32(_long(a) + _long(b))


def sub_sat32(a: Column | str, b: Column | str) -> Column:
    return saturate32(_long(a) - _long(b))


def _shift(name: str, x: Column, n: Column | int) -> Column:
    """shiftleft or shiftright by a column's number of bits."""
    return F.call_function(name, _long(x), (F.lit(n) if isinstance(n, int) else n).cast("int"))


def lshift_sat32(a: Column | str, n: Column | int) -> Column:
    """Left shift after clipping to what stays within 32 bits."""
    lo, hi = _shift("shiftright", F.lit(-(1 << 31)), n), _shift("shiftright", F.lit((1 << 31) - 1), n)
    return _shift("shiftleft", F.greatest(lo, F.least(hi, _long(a))), n)


def _quotient(a: Column, b: Column) -> Column:
    """Integer quotient towards zero."""
    return F.signum(a.cast("double")).cast("long") * F.signum(b.cast("double")).cast("long") * F.floor(F.abs(a) / F.abs(b)).cast("long")


def _reciprocal(b: Column) -> tuple[Column, Column, Column]:
    """Headroom of a 32-bit value, the value without it, and the first guess of its reciprocal."""
    head = clz32(F.abs(b)) - 1
    norm = _shift("shiftleft", b, head)
    return head, norm, _quotient(F.lit(((1 << 31) - 1) >> 2).cast("long"), F.shiftright(norm, 16))


def _scaled(result: Column, n: Column) -> Column:
    """Right shift by n bits, saturated left shift where n is negative, 0 beyond 31."""
    return F.when(n < 0, lshift_sat32(result, F.greatest(-n, F.lit(0)))).when(n < 32, _shift("shiftright", result, F.greatest(F.lit(0), F.least(n, F.lit(31))))).otherwise(0)


def inverse32(b: Column | str, q: int) -> Column:
    """Approximate 2**q / b of a 32-bit value that isn't 0: a guess and one correction."""
    head, norm, guess = _reciprocal(_long(b))
    error = ((1 << 29) - smulwb(norm, guess)) * 8
    return _scaled(smlaww(guess * 65536, error, guess), 61 - head - q)


def divide32(a: Column | str, b: Column | str, q: int) -> Column:
    """Approximate a * 2**q / b: a guess by the reciprocal and one correction with the rest."""
    a, b = _long(a), _long(b)
    head_a = clz32(F.abs(a)) - 1
    norm_a = _shift("shiftleft", a, head_a)
    head_b, norm_b, guess = _reciprocal(b)
    first = smulwb(norm_a, guess)
    rest = wrap32(norm_a - wrap32(smmul(norm_b, first) * 8))
    return _scaled(smlawb(first, rest, guess), 29 + head_a - head_b - q)


def log2lin(x: Column | str) -> Column:
    """2**(x / 128) by a parabola between powers of two; 0 below 0, the largest value from 3967 on."""
    x = _long(x)
    power = _shift("shiftleft", F.lit(1), F.shiftright(F.greatest(x, F.lit(0)), 7))
    part = x.bitwiseAND(F.lit(127))
    curve = smlawb(part, smulbb(part, 128 - part), F.lit(-174))
    small, large = power + F.shiftright(power * curve, 7), power + F.shiftright(power, 7) * curve
    return F.when(x < 0, 0).when(x >= 3967, (1 << 31) - 1).when(x < 2048, wrap32(small)).otherwise(wrap32(large)).cast("long")


def symmetric_dequant(code: Column | str, levels: Column | str | int) -> Column:
    """(2m - (L - 1)) / L in units of 2**-24, towards zero."""
    levels = _long(levels)
    return _quotient((_long(code) * 2 - (levels - 1)) * (1 << 23), levels)


def round_shift(a: Column | str, n: int) -> Column:
    a = _long(a)
    return F.shiftright(a, 1) + a.bitwiseAND(F.lit(1)) if n == 1 else F.shiftright(F.shiftright(a, n - 1) + 1, 1)


def clz32(x: Column | str) -> Column:
    return 32 - ilog(_long(x).bitwiseAND(F.lit(U32)))


def limit(a: Column | str, b1: Column | int, b2: Column | int) -> Column:
    lo, hi = F.least(_long(b1), _long(b2)), F.greatest(_long(b1), _long(b2))
    return F.greatest(lo, F.least(hi, _long(a)))


def frac_mul16(a: Column | str | int, b: Column | str | int) -> Column:
    return F.shiftright(_long(a) * _long(b) + 16384, 15)


def bitexact_cos(x: Column | str) -> Column:
    x = _long(x)
    x2 = F.shiftright(x * x + 4096, 13)
    return 1 + (32767 - x2) + frac_mul16(x2, frac_mul16(x2, frac_mul16(-626, x2) + 8277) - 7651)


def bitexact_log2tan(isin: Column | str, icos: Column | str) -> Column:
    ls, lc = ilog(isin), ilog(icos)
    s = (_long(isin) * F.pow(F.lit(2), 15 - ls)).cast("long")
    c = (_long(icos) * F.pow(F.lit(2), 15 - lc)).cast("long")
    part = lambda v: frac_mul16(v, frac_mul16(v, -2597) + 7932)
    return (ls - lc) * 2048 + part(s) - part(c)


def pulses_of(i: Column | str) -> Column:
    """Pseudo-exponential pulse count of an index."""
    i = _long(i)
    return F.when(i < 8, i).otherwise(((8 + i.bitwiseAND(F.lit(7))) * F.pow(F.lit(2), F.shiftright(i, 3) - 1)).cast("long"))


def lcg(seed: Column | str | int, a: int = 1664525, c: int = 1013904223) -> Column:
    """One step of a linear congruential generator modulo 2**32 (products split so they fit 63 bits)."""
    s = _long(seed)
    hi, lo = F.shiftrightunsigned(s, 16), s.bitwiseAND(F.lit(0xFFFF))
    return ((hi * a).bitwiseAND(F.lit(0xFFFF)) * 65536 + lo * a + c).bitwiseAND(F.lit(U32))


def lcg_jump(seed: int, steps: Column | str, a: int = 1664525, c: int = 1013904223, bits: int = 32) -> Column:
    """The generator after any number of steps, by squaring: x_n = A x_0 + C with (A, C) composed bit by bit.

    A draw's value follows from its running number alone, so draws need no order of execution.
    """
    pairs, aa, cc = [], a, c
    for k in range(bits):
        pairs.append(F.struct(F.lit(k).alias("k"), F.lit(aa).cast("long").alias("a"), F.lit(cc).cast("long").alias("c")))
        aa, cc = aa * aa & U32, (aa * cc + cc) & U32
    n = _long(steps)

    def step(x: Column, p: Column) -> Column:
        jumped = (F.shiftrightunsigned(x, 16) * p["a"]).bitwiseAND(F.lit(0xFFFF)) * 65536 + x.bitwiseAND(F.lit(0xFFFF)) * p["a"] + p["c"]
        bit = F.floor(n / F.pow(F.lit(2.0), p["k"])) % 2
        return F.when(bit == 1, jumped.bitwiseAND(F.lit(U32))).otherwise(x)

    return F.aggregate(F.array(*pairs), F.lit(seed).cast("long"), step)


def dynamic_range(b: Column | str) -> Column:
    """DYNRNG byte to gain: a signed 3-bit exponent and a 5-bit fraction with a leading one."""
    b = _long(b)
    e = F.shiftright(b, 5)
    e = F.when(e >= 4, e - 8).otherwise(e)
    return (32 + b.bitwiseAND(F.lit(31))).cast("double") / 64 * F.pow(F.lit(2.0), e + 1)


def ungroup5(v: Column | str) -> Column:
    """Three base-5 digits of a group."""
    v = _long(v)
    return F.array(F.floor(v / 25).cast("int"), F.floor((v % 25) / 5).cast("int"), (v % 5).cast("int"))
