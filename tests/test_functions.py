"""Column functions against plain integer versions."""

import math

from pyspark.sql import functions as F

from sonaril.functions import bits, fixed, g711, headers
from sonaril.functions.pcm import clamp16, gain


def mu_plain(s):
    m = min(32635, abs(s)) + 132
    e = max((m >> 7 & 255).bit_length() - 1, 0)
    return 255 - ((128 if s < 0 else 0) | e << 4 | m >> e + 3 & 15)


def a_plain(s):
    v, mask = (s >> 3, 0xD5) if s >= 0 else (-(s >> 3) - 1, 0x55)
    g = 0 if v < 32 else min(7, (v >> 5).bit_length())
    return (g << 4 | (v >> 1 if g < 2 else v >> g) & 15) ^ mask


def test_companding_of_every_sample(spark):
    df = spark.range(-32768, 32768).select(F.col("id").cast("int").alias("s"))
    rows = df.select("s", g711.mulaw_encode("s").alias("m"), g711.alaw_encode("s").alias("a")).toPandas()
    assert all(mu_plain(s) == m for s, m in zip(rows.s, rows.m, strict=True))
    assert all(a_plain(s) == a for s, a in zip(rows.s, rows.a, strict=True))


def test_codes_round_trip(spark):
    """Every code decodes to a sample that encodes to it; the two zeros of the first law are one."""
    df = spark.range(256).select(F.col("id").cast("int").alias("c"))
    r = df.select("c", g711.mulaw_encode(g711.mulaw_decode("c")).alias("m"), g711.alaw_encode(g711.alaw_decode("c")).alias("a")).toPandas()
    assert list(r[r.m != r.c].c) == [0x7F] and (r.a == r.c).all()


def test_half_even_and_clipping(spark):
    r = spark.createDataFrame([(2.5,), (3.5,), (-2.5,), (40000.0,), (-40000.0,), (32767.4,)], "x double").select(clamp16("x").alias("y")).toPandas()
    assert list(r.y) == [2, 4, -2, 32767, -32768, 32767]
    assert spark.range(1).select(gain(F.lit(30000), 2.0)).first()[0] == 32767


def test_byte_fields(spark):
    b = bytearray(b"ID3\x04\x00\x00\x00\x00\x02\x01rest")
    row = spark.createDataFrame([(b,)], "b binary").select(bits.id3v2_size("b"), bits.unsigned_be("b", 0, 4), bits.unsigned_le("b", 0, 4), bits.byte_array("b"), bits.byte_at("b", 99)).first()
    assert row[0] == 10 + 257 and row[1] == int.from_bytes(b[:4], "big") and row[2] == int.from_bytes(b[:4], "little")
    assert row[3] == list(b) and row[4] is None


def test_checks(spark):
    row = spark.createDataFrame([(bytearray(b"123456789"),)], "b binary").select(bits.crc8(bits.byte_array("b")), bits.crc16(bits.byte_array("b"))).first()
    assert row[0] == 0xF4 and row[1] == 0xFEE8


def test_numbers(spark):
    df = spark.range(1, 2000)
    r = df.select("id", bits.ilog("id").alias("l"), bits.lookup1_values(F.col("id").cast("int"), F.lit(3)).alias("r"), bits.unfold_zigzag("id").alias("z")).toPandas()
    assert all(x.bit_length() == y for x, y in zip(r.id, r.l, strict=True))
    assert all(v**3 <= x < (v + 1) ** 3 for x, v in zip(r.id, r.r, strict=True))
    assert all(z == (x // 2 if x % 2 == 0 else -(x // 2) - 1) for x, z in zip(r.id, r.z, strict=True))


def test_generator_jump(spark):
    r = spark.range(300).select(fixed.lcg_jump(12345, "id", bits=10).alias("x")).toPandas()
    x, want = 12345, []
    for _ in range(300):
        want.append(x)
        x = (x * 1664525 + 1013904223) % 2**32
    assert list(r.x) == want


def test_fixed_point_cosine(spark):
    r = spark.range(0, 16384, 37).select("id", fixed.bitexact_cos("id").alias("c")).toPandas()
    assert all(abs(c / 32768 - math.cos(math.pi / 2 * x / 16384)) < 2e-3 for x, c in zip(r.id, r.c, strict=True))


def test_sniff_and_headers(spark):
    files = {"flac": b"fLaC....", "ogg": b"OggS....", "mp4": b"\0\0\0\x18ftypM4A ", "wav": b"RIFF....WAVE", "ac3": b"\x0b\x77\0\0\x14\x40\0\0", "adts": bytes([0xFF, 0xF1, 0x50, 0x80, 0x02, 0x1F, 0xFC, 0, 0]), "mpeg": b"\xff\xfb\x90\x00rest", "unknown": b""}
    rows = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "k string, b binary").select("k", headers.sniff("b").alias("s")).collect()
    assert all(r.k == r.s for r in rows)
    h = spark.range(1).select(headers.mpeg_header(F.lit(0xFFFB9000)).alias("h")).first().h
    assert h.sample_rate == 44100 and h.bitrate == 128000 and h.frame_length == 417 and h.channels == 2
    t = spark.createDataFrame([(0, 0, 128000, 2, 44100)], "i int, j int, b int, c int, r int").select(headers.layer2_table("b", "c", "r", F.lit(False))).first()[0]
    assert t == 0


def coded(v):
    """Bytes of a coded number, by the rule: the fewest bytes that hold it."""
    if v < 0x80:
        return bytes([v])
    n = next(n for n in range(2, 8) if v < 1 << (5 * n + 1))
    return bytes([0xFF << 8 - n & 0xFF | v >> 6 * (n - 1), *(0x80 | v >> 6 * k & 0x3F for k in reversed(range(n - 1)))])


def test_coded_numbers_of_every_length(spark):
    vs = [0, 127, *(x for n in range(2, 8) for x in ((1 << 5 * n + 1) - 1, 1 << 5 * n + 1))][:-1] + [65535, 65536, 123456789, 9876543210]
    assert [coded(v) for v in (127, 0x1F600)] == [b"\x7f", "\U0001f600".encode()] and max(vs) == 2**36 - 1 and len(coded(max(vs))) == 7
    bad = [b"", b"\x80", b"\xff" + b"\x80" * 6, *(coded(v)[:-1] for v in vs if v > 127), *(coded(v)[:-1] + b"\x00" for v in vs if v > 127)]
    df = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate([coded(v) + b"\xbf" for v in vs] + bad)], "i int, b binary")
    got = [r.v for r in df.select("i", bits.coded_number("b").alias("v")).orderBy("i").collect()]
    assert got == vs + [None] * len(bad)
