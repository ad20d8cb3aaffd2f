"""Bytes, bit fields and checks at fixed offsets of a binary column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sonaril.functions.pcm import col


def byte_at(b: Column | str, i: int | Column) -> Column:
    """Unsigned byte at a zero-based offset; null past the end."""
    at = F.lit(i) if isinstance(i, int) else i
    h = F.hex(F.substring(col(b), at + 1, F.lit(1)))
    return F.when(h != "", F.conv(h, 16, 10).cast("int"))


def byte_array(b: Column | str) -> Column:
    """All bytes as an array of unsigned integers; the binary is evaluated once, whatever expression it is."""
    pairs = F.regexp_extract_all(F.hex(col(b)), F.lit("(..)"), F.lit(1))
    return F.transform(pairs, lambda x: F.conv(x, 16, 10).cast("int"))


def unsigned_be(b: Column | str, i: int | Column, n: int) -> Column:
    at = F.lit(i) if isinstance(i, int) else i
    return F.conv(F.hex(F.substring(col(b), at + 1, F.lit(n))), 16, 10).cast("long")


def unsigned_le(b: Column | str, i: int, n: int) -> Column:
    out = F.lit(0).cast("long")
    for k in range(n):
        out = out + byte_at(b, i + k).cast("long") * (1 << (8 * k))
    return out


def bit_field(word: Column | str, low: int, n: int) -> Column:
    """``n`` bits of a word from bit ``low`` up."""
    return F.shiftrightunsigned(col(word).cast("long"), low).bitwiseAND(F.lit((1 << n) - 1))


def bits_at(b: Column | str, at: int, n: int) -> Column:
    """``n`` <= 16 bits of a binary from a bit position on, most significant first; null past the end."""
    end = 8 * (-(-(at + n) // 8))
    word = F.lit(0).cast("long")
    for k in range(at // 8, end // 8):
        word = word * 256 + byte_at(b, k)
    return bit_field(word, end - at - n, n).cast("int")


def unary(word: Column | str, width: int) -> Column:
    """Zeros before the first one of a word of ``width`` bits."""
    return F.lit(width) - ilog(word)


def sign_extend(x: Column | str, n: int) -> Column:
    x = col(x)
    return F.when(x >= (1 << (n - 1)), x - (1 << n)).otherwise(x)


def syncsafe(b: Column | str, i: int) -> Column:
    out = F.lit(0).cast("long")
    for k in range(4):
        out = out * 128 + byte_at(b, i + k).bitwiseAND(127)
    return out


def id3v2_size(b: Column | str) -> Column:
    """Bytes of a leading tag, 0 if there is none."""
    return F.when((F.octet_length(col(b)) >= 10) & (F.substring(col(b), 1, 3) == F.encode(F.lit("ID3"), "utf-8")), syncsafe(b, 6) + 10).otherwise(F.lit(0).cast("long"))


def audio_end(b: Column | str) -> Column:
    """Length without a trailing 128-byte tag."""
    n = F.octet_length(col(b))
    return F.when((n >= 128) & (F.substring(col(b), F.greatest(n - 127, F.lit(1)), F.lit(3)) == F.encode(F.lit("TAG"), "utf-8")), n - 128).otherwise(n)


def ilog(x: Column | str) -> Column:
    """Bit length; 0 for anything not positive."""
    x = col(x).cast("long")
    return F.when(x > 0, F.length(F.bin(x))).otherwise(0)


def float32_unpack(x: Column | str) -> Column:
    """21-bit mantissa, sign, and exponent biased by 788; not an IEEE number."""
    x = col(x).cast("long")
    m = x.bitwiseAND(F.lit(0x1FFFFF)).cast("double")
    e = bit_field(x, 21, 10).cast("double")
    return F.when(bit_field(x, 31, 1) == 1, -m).otherwise(m) * F.pow(F.lit(2.0), e - 788)


def lookup1_values(entries: Column | str, dimensions: Column | str, most: int = 4096) -> Column:
    """Largest r with r**dimensions <= entries, by search in integers."""
    e, d = col(entries), col(dimensions)
    top = F.least(F.lit(most), e).cast("int")
    guess = F.floor(F.pow(e.cast("double"), 1.0 / d)).cast("int")
    near = F.filter(F.sequence(F.greatest(guess - 2, F.lit(0)), F.least(guess + 2, top)), lambda r: F.pow(r.cast("double"), d.cast("double")) <= e)
    return F.coalesce(F.array_max(near), F.lit(0))


def unfold_zigzag(u: Column | str) -> Column:
    """Folded residual to signed: even halves up, odd ones down."""
    u = col(u).cast("long")
    half = F.shiftright(u, 1)
    return F.when(u % 2 == 0, half).otherwise(-half - 1)


def coded_number(b: Column | str) -> Column:
    """Value (long) of a one- to seven-byte coded number at the start of a binary; null where none starts."""
    c = [byte_at(b, i).cast("long") for i in range(7)]
    out = F.when(c[0] < 0x80, c[0])
    for n in range(2, 8):  # n leading ones, a zero, and n - 1 bytes of six bits each
        starts = c[0].bitwiseAND(0xFF << 7 - n & 0xFF) == (0xFF << 8 - n & 0xFF)
        value = c[0].bitwiseAND((1 << 7 - n) - 1)
        for x in c[1:n]:
            starts = starts & (x.bitwiseAND(0xC0) == 0x80)
            value = value * 64 + x.bitwiseAND(0x3F)
        out = out.when(starts, value)
    return out


def crc_table(width: int, poly: int) -> list[int]:
    """What each value of the leading byte adds, from the rule: shift, and subtract the polynomial where a bit leaves."""
    top, mask, out = 1 << (width - 1), (1 << width) - 1, []
    for v in range(256):
        c = v << (width - 8)
        for _ in range(8):
            c = (c << 1 ^ (poly if c & top else 0)) & mask
        out.append(c)
    return out


def crc(bytes_: Column | str, width: int, poly: int, init: int = 0) -> Column:
    """Cyclic check of a byte array, most significant bit first: one table step per byte."""
    table = F.array(*map(F.lit, crc_table(width, poly)))
    keep = (1 << (width - 8)) - 1

    def step(c: Column, b: Column) -> Column:
        lead = F.shiftright(c, width - 8).bitwiseXOR(b)
        return F.element_at(table, lead + 1).bitwiseXOR(c.bitwiseAND(keep) * 256)

    return F.aggregate(col(bytes_), F.lit(init), step)


def crc8(bytes_: Column | str) -> Column:
    return crc(bytes_, 8, 0x07)


def crc16(bytes_: Column | str) -> Column:
    return crc(bytes_, 16, 0x8005)
