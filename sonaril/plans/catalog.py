"""Queries over the driver's tables, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonaril.functions import bits, fixed, g711, headers
from sonaril.functions.pcm import clamp16, full_scale
from sonaril.operators import framing, metrics, mixing, packets, predict, resample, signals, spectral

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = sql
        return f

    return add


def _clamp(x: str) -> str:
    return f"CAST(greatest(-32768, least(32767, round_even({x}, 0))) AS INTEGER)"


# --------------------------------------------------------------------------- bindings in SQL
SIG = f"sig AS (SELECT event_type AS stream_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS n, {_clamp('round_even(value * 100, 0) - 16384')} AS s FROM events)"
STEREO = SIG + ", stereo AS (SELECT stream_id, n // 2 AS n, CAST(n % 2 AS INTEGER) AS ch, s FROM sig)"
PAIRS = STEREO + ", pairs AS (SELECT stream_id, n, max(CASE WHEN ch = 0 THEN s END) AS a, max(CASE WHEN ch = 1 THEN s END) AS b FROM stereo GROUP BY 1, 2 HAVING count(*) = 2)"
MIX = f"mixsrc AS (SELECT l_orderkey AS n, l_linenumber AS source, {_clamp('round_even(l_extendedprice / 2, 0) - 26000')} AS s, 1 - l_discount AS gain FROM lineitem)"
SPEC = "spec AS (SELECT vec_id AS frame, CAST(unnest(range(len(embedding))) AS INTEGER) AS k, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"
_NIB = "(strpos('0123456789ABCDEF', substr(hx, {0}, 1)) - 1)"


def _byte(i: int | str) -> str:
    at = f"2 * ({i}) + 1"
    return f"({_NIB.format(at)} * 16 + {_NIB.format(f'2 * ({i}) + 2')})"


RAW = "raw AS (SELECT doc_id, hex(encode(text)) AS hx, CAST(octet_length(encode(text)) AS INTEGER) AS len FROM documents WHERE text IS NOT NULL)"
BYTES = RAW + f", bytes AS (SELECT doc_id, list_transform(range(len), lambda i: CAST({_byte('i')} AS INTEGER)) AS b FROM raw)"
HEADS = RAW + ", head AS (SELECT doc_id, " + ", ".join(f"CASE WHEN len > {i} THEN CAST({_byte(i)} AS BIGINT) END AS b{i}" for i in range(8)) + " FROM raw)"


def raw(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, b): documents as packets."""
    return signals.table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", F.encode("text", "utf-8").alias("b"))


def word32(b="b"):
    return bits.unsigned_be(b, 0, 4)


WORD = HEADS + ", w AS (SELECT doc_id, ((b0 * 256 + b1) * 256 + b2) * 256 + b3 AS w FROM head WHERE b3 IS NOT NULL)"


# --------------------------------------------------------------------------- PCM
@query(f"WITH {SIG} SELECT stream_id, n, s FROM sig")
def pcm_from_events(spark, sf):
    return signals.sig(spark, sf)


_MU = """(CASE WHEN s < 0 THEN 128 ELSE 0 END) AS sg, least(32635, abs(s)) + 132 AS m"""
_MU_SQL = f"mu0 AS (SELECT stream_id, n, s, {_MU} FROM sig), mu1 AS (SELECT *, CASE WHEN (m >> 7) & 255 = 0 THEN 0 ELSE length(bin((m >> 7) & 255)) - 1 END AS e FROM mu0), mu AS (SELECT stream_id, n, s, CAST(255 - (sg + e * 16 + ((m >> (e + 3)) & 15)) AS INTEGER) AS code FROM mu1)"
_MUD_SQL = "mud AS (SELECT stream_id, n, s, code, CAST((CASE WHEN code < 128 THEN -1 ELSE 1 END) * ([0, 132, 396, 924, 1980, 4092, 8316, 16764][(((255 - code) >> 4) & 7) + 1] + (((255 - code) & 15) << ((((255 - code) >> 4) & 7) + 3))) AS INTEGER) AS d FROM mu)"
_AL_SQL = "a0 AS (SELECT stream_id, n, s, s >> 3 AS v0 FROM sig), a1 AS (SELECT *, CASE WHEN v0 >= 0 THEN 213 ELSE 85 END AS mask, CASE WHEN v0 >= 0 THEN v0 ELSE -v0 - 1 END AS v FROM a0), a2 AS (SELECT *, CASE WHEN v < 32 THEN 0 ELSE least(7, length(bin(v >> 5))) END AS g FROM a1), al AS (SELECT stream_id, n, s, CAST(xor(g * 16 + (CASE WHEN g < 2 THEN v >> 1 ELSE v >> g END & 15), mask) AS INTEGER) AS code FROM a2)"
_ALD_SQL = "ald0 AS (SELECT *, xor(code, 85) AS a FROM al), ald AS (SELECT stream_id, n, s, code, CAST((CASE WHEN a & 128 = 0 THEN -1 ELSE 1 END) * (CASE (a & 112) >> 4 WHEN 0 THEN ((a & 15) << 4) + 8 WHEN 1 THEN ((a & 15) << 4) + 264 ELSE (((a & 15) << 4) + 264) << (((a & 112) >> 4) - 1) END) AS INTEGER) AS d FROM ald0)"


@query(f"WITH {SIG}, {_MU_SQL} SELECT stream_id, n, code FROM mu")
def mulaw_encode(spark, sf):
    return signals.sig(spark, sf).select("stream_id", "n", g711.mulaw_encode("s").alias("code"))


@query(f"WITH {SIG}, {_MU_SQL}, {_MUD_SQL} SELECT stream_id, n, d FROM mud")
def mulaw_decode(spark, sf):
    return signals.sig(spark, sf).select("stream_id", "n", g711.mulaw_decode(g711.mulaw_encode("s")).alias("d"))


@query(f"WITH {SIG}, {_AL_SQL} SELECT stream_id, n, code FROM al")
def alaw_encode(spark, sf):
    return signals.sig(spark, sf).select("stream_id", "n", g711.alaw_encode("s").alias("code"))


@query(f"WITH {SIG}, {_AL_SQL}, {_ALD_SQL} SELECT stream_id, n, d FROM ald")
def alaw_decode(spark, sf):
    return signals.sig(spark, sf).select("stream_id", "n", g711.alaw_decode(g711.alaw_encode("s")).alias("d"))


@query(f"WITH {SIG}, {_MU_SQL}, {_MUD_SQL} SELECT stream_id, n // 160 AS frame_no, CAST(max(abs(s - d)) AS INTEGER) AS peak, CAST(sum((s - d) * (s - d)) AS BIGINT) AS sum_sq, round(sqrt(sum((s - d) * (s - d)) / count(*)), 6) + 0.0 AS rms FROM mud GROUP BY 1, 2")
def g711_roundtrip_error(spark, sf):
    e = signals.sig(spark, sf).withColumn("e", F.col("s") - g711.mulaw_decode(g711.mulaw_encode("s")))
    g = e.groupBy("stream_id", F.floor(F.col("n") / 160).alias("frame_no")).agg(F.max(F.abs("e")).alias("peak"), F.sum(F.col("e") * F.col("e")).alias("sum_sq"), F.count("*").alias("c"))
    return g.select("stream_id", "frame_no", "peak", "sum_sq", F.round(F.sqrt(F.col("sum_sq") / F.col("c")), 6).alias("rms"))


@query(f"WITH {STEREO} SELECT stream_id, n, {_clamp('sum(s) / count(*)')} AS s FROM stereo GROUP BY 1, 2")
def downmix(spark, sf):
    return mixing.downmix(signals.stereo(spark, sf))


@query(f"WITH {SIG} SELECT stream_id, n, {_clamp('1.7 * s')} AS s FROM sig".replace("1.7 * s", "CAST(1.7 AS DOUBLE) * s"))
def apply_gain(spark, sf):
    return mixing.apply_gain(signals.sig(spark, sf), 1.7)


@query(f"WITH {MIX} SELECT n, {_clamp('sum(round_even(gain * s, 0))')} AS s FROM mixsrc GROUP BY 1")
def mix_sources(spark, sf):
    return mixing.mix(signals.mixsrc(spark, sf))


@query(f"WITH {MIX}, g(source, gain) AS (VALUES (1, CAST(0.5 AS DOUBLE)), (2, CAST(0.25 AS DOUBLE)), (3, CAST(1.5 AS DOUBLE))) SELECT n, {_clamp('sum(round_even(coalesce(g.gain, 1.0) * s, 0))')} AS s FROM mixsrc LEFT JOIN g USING (source) GROUP BY 1")
def mix_ragged(spark, sf):
    gains = spark.createDataFrame([(1, 0.5), (2, 0.25), (3, 1.5)], "source int, gain double")
    return mixing.mix(signals.mixsrc(spark, sf), gains)


# --------------------------------------------------------------------------- frames
@query(f"WITH {SIG} SELECT stream_id, n // 160 AS frame_no, CAST(count(*) AS INTEGER) AS len, string_agg(CAST(s AS VARCHAR), ' ' ORDER BY n) AS samples FROM sig GROUP BY 1, 2")
def frame_tumbling(spark, sf):
    return framing.tumbling(signals.sig(spark, sf)).withColumn("samples", F.array_join(F.col("samples").cast("array<string>"), " "))


@query(f"WITH {SIG} SELECT stream_id, n // 800 AS frame_no, CAST(max(abs(s)) AS BIGINT) AS peak, CAST(sum(CAST(s AS BIGINT) * s) AS BIGINT) AS sum_sq, round(sqrt(sum(CAST(s AS BIGINT) * s) / count(*)), 6) + 0.0 AS rms FROM sig GROUP BY 1, 2")
def envelope_rms(spark, sf):
    return framing.envelope(signals.sig(spark, sf)).withColumn("rms", F.round("rms", 6))


@query(f"WITH {SIG} SELECT stream_id, n - 312 AS n, s FROM sig WHERE n >= 312 AND n < 312 + 1500")
def trim_delay(spark, sf):
    return framing.trim(signals.sig(spark, sf), 312, 1500)


def _kernel_sql(a: int, b: int) -> str:
    cutoff, half = resample.kernel_shape(a, b)
    return (
        f"kern AS (SELECT i, {cutoff!r} * (CASE WHEN i = 0 THEN 1.0 ELSE sin(pi() * {cutoff!r} * i / 64.0) / (pi() * {cutoff!r} * i / 64.0) END)"
        f" * (0.42 + 0.5 * cos(pi() * i / {half * 64}.0) + 0.08 * cos(2 * pi() * i / {half * 64}.0)) AS w FROM range({half * 64 + 1}) t(i)),"
        f" kern2 AS (SELECT k.i, k.w, coalesce(l.w, 0.0) AS w2 FROM kern k LEFT JOIN kern l ON l.i = k.i + 1)"
    )


def _resample_sql(a: int, b: int) -> str:
    _, half = resample.kernel_shape(a, b)
    g = math.gcd(a, b)
    num, den = a // g, b // g
    return (
        f"WITH {SIG}, {_kernel_sql(a, b)}, len AS (SELECT stream_id, max(n) + 1 AS len FROM sig GROUP BY 1),"
        f" outs AS (SELECT stream_id, len, j, {half}.0 + j * {num} / {den}.0 AS p FROM (SELECT stream_id, len, unnest(range(CAST(ceil((len - {half}) * {den} / {num}.0) AS BIGINT))) AS j FROM len WHERE len > {half})),"
        f" taps AS (SELECT o.stream_id, j, x.s, abs(x.n - p) * 64.0 AS d FROM outs o JOIN sig x ON x.stream_id = o.stream_id AND x.n BETWEEN ceil(p - {half}) AND floor(p + {half}))"
        f" SELECT stream_id, j AS n, {_clamp(f'sum(CASE WHEN floor(d) >= {half * 64} THEN 0.0 ELSE (1 - (d - floor(d))) * w + (d - floor(d)) * w2 END * s)')} AS s FROM taps JOIN kern2 ON i = CAST(floor(d) AS BIGINT) GROUP BY 1, 2"
    )


@query(_resample_sql(44100, 8000))
def resample_441_8(spark, sf):
    return resample.resample(signals.sig(spark, sf), 44100, 8000)


@query(_resample_sql(8000, 16000))
def resample_8_16(spark, sf):
    return resample.resample(signals.sig(spark, sf), 8000, 16000)


@query(f"WITH {SIG}, w AS (SELECT i, pow(sin(pi() / 2 * pow(sin(pi() / 2 * (i + 0.5) / 120), 2)), 2) AS w FROM range(120) t(i)) SELECT b.stream_id, b.n, round(CASE WHEN w IS NULL THEN CAST(b.s AS DOUBLE) ELSE w * b.s + (1 - w) * a.s END, 4) + 0.0 AS y FROM sig b JOIN (SELECT stream_id, n - 500 AS n, s FROM sig WHERE n >= 500) a USING (stream_id, n) LEFT JOIN w ON i = b.n")
def crossfade(spark, sf):
    s = signals.sig(spark, sf)
    return framing.crossfade(framing.trim(s, 500), s).withColumn("y", F.round("y", 4))


# --------------------------------------------------------------------------- stereo
@query(f"WITH {PAIRS} SELECT stream_id, n, (2 * CAST(a AS BIGINT) + (b & 1) + b) >> 1 AS l, (2 * CAST(a AS BIGINT) + (b & 1) - b) >> 1 AS r FROM pairs")
def mid_side(spark, sf):
    return mixing.undo_decorrelation(mixing.pair_channels(signals.stereo(spark, sf)), "mid_side")


@query(f"WITH {PAIRS} SELECT stream_id, n, CAST(a AS BIGINT) AS l, CAST(a AS BIGINT) - b AS r FROM pairs")
def left_side(spark, sf):
    return mixing.undo_decorrelation(mixing.pair_channels(signals.stereo(spark, sf)), "left_side")


@query(f"WITH {PAIRS} SELECT stream_id, n, CAST(a AS BIGINT) + b AS l, CAST(b AS BIGINT) AS r FROM pairs")
def side_right(spark, sf):
    return mixing.undo_decorrelation(mixing.pair_channels(signals.stereo(spark, sf)), "side_right")


SPEC_PAIRS = SPEC + ", two AS (SELECT frame // 2 AS frame, k, max(CASE WHEN frame % 2 = 0 THEN x END) AS a, max(CASE WHEN frame % 2 = 1 THEN x END) AS b FROM spec GROUP BY 1, 2 HAVING count(*) = 2)"


def _spec_pairs(spark, sf):
    s = signals.spec(spark, sf).withColumn("ch", (F.col("frame") % 2).cast("int")).withColumn("frame", F.floor(F.col("frame") / 2))
    return mixing.pair_channels(s, "x", ("frame", "k"))


def _lr(df):
    return df.withColumn("l", F.round("l", 8)).withColumn("r", F.round("r", 8))


@query(f"WITH {SPEC_PAIRS} SELECT frame, k, round((a + b) * pow(2, -0.5), 8) + 0.0 AS l, round((a - b) * pow(2, -0.5), 8) + 0.0 AS r FROM two")
def ms_rotation(spark, sf):
    return _lr(mixing.rotate_ms(_spec_pairs(spark, sf)))


@query(f"WITH {SPEC_PAIRS} SELECT frame, k, round(CASE WHEN a > 0 AND b > 0 THEN a WHEN a > 0 THEN a + b WHEN b > 0 THEN a ELSE a - b END, 8) + 0.0 AS l, round(CASE WHEN a > 0 AND b > 0 THEN a - b WHEN a > 0 THEN a WHEN b > 0 THEN a + b ELSE a END, 8) + 0.0 AS r FROM two")
def polar_coupling(spark, sf):
    return _lr(mixing.uncouple_polar(_spec_pairs(spark, sf)))


@query(f"WITH {SPEC_PAIRS} SELECT frame, k, round(a + b, 8) + 0.0 AS l, round(a - b, 8) + 0.0 AS r FROM two")
def ac3_rematrix(spark, sf):
    return _lr(mixing.rematrix(_spec_pairs(spark, sf)))


@query(f"WITH {SPEC} SELECT frame, k, round(CASE WHEN (frame + k // 8) % 8 = 6 THEN x WHEN (frame + k // 8) % 8 = 7 THEN x ELSE x * tan(((frame + k // 8) % 8) * pi() / 12) / (1 + tan(((frame + k // 8) % 8) * pi() / 12)) END, 8) + 0.0 AS l, round(CASE WHEN (frame + k // 8) % 8 IN (6, 7) THEN 0.0 ELSE x / (1 + tan(((frame + k // 8) % 8) * pi() / 12)) END, 8) + 0.0 AS r FROM spec")
def intensity_stereo(spark, sf):
    s = signals.spec(spark, sf).withColumn("band", F.floor(F.col("k") / 8).cast("int"))
    pos = s.select("frame", "band").distinct().withColumn("pos", ((F.col("frame") + F.col("band")) % 8).cast("int"))
    return _lr(mixing.intensity(s, pos))


# --------------------------------------------------------------------------- predictors
def _fixed(order: int):
    def run(spark, sf):
        return predict.fixed_predict(predict.fixed_residual(signals.sig(spark, sf), order), order)

    # the inverse of the difference is the signal itself; its residual is checked separately
    query(f"WITH {SIG} SELECT stream_id, n, CAST(s AS BIGINT) AS s FROM sig", f"fixed_predict_{order}")(run)


for _k in range(5):
    _fixed(_k)


def _residual_sql(order: int) -> str:
    w = "OVER (PARTITION BY stream_id ORDER BY n)"
    terms = " ".join(f"{'+' if k % 2 == 0 else '-'} {math.comb(order, k)} * lag(s, {k}) {w}" for k in range(1, order + 1))
    return f"WITH {SIG} SELECT stream_id, n, CAST(CASE WHEN n < {order} THEN s ELSE s {terms} END AS BIGINT) AS r FROM sig"


@query(_residual_sql(2))
def fixed_residual_2(spark, sf):
    return predict.fixed_residual(signals.sig(spark, sf), 2)


@query(f"WITH {SPEC} SELECT frame, k AS band, CAST(100 + sum(round_even(x * 100, 0)) OVER (PARTITION BY frame ORDER BY k) AS BIGINT) AS v FROM spec")
def delta_scalefactors(spark, sf):
    d = signals.spec(spark, sf).select("frame", F.col("k").alias("band"), (F.rint(F.col("x") * 100) + 60).cast("long").alias("d"))
    return predict.delta_chain(d, 100, 60)


@query(f"""WITH RECURSIVE {SPEC}, d AS (SELECT frame, k, CAST(round_even(x * 40, 0) AS INTEGER) AS d FROM spec),
f AS (SELECT frame, k, CAST(greatest(-5, least(5, d)) AS INTEGER) AS v FROM d WHERE k = 0 UNION ALL SELECT d.frame, d.k, CAST(greatest(-5, least(5, f.v + d.d)) AS INTEGER) FROM f JOIN d ON d.frame = f.frame AND d.k = f.k + 1)
SELECT frame, CAST(k AS BIGINT) AS k, v FROM f""")
def clamped_gain_chain(spark, sf):
    d = signals.table(spark, sf, "embeddings").select(F.col("vec_id").alias("frame"), F.transform("embedding", lambda x: F.rint(x.cast("double") * 40).cast("int")).alias("steps"))
    return predict.clamped_chain(d, -5, 5).select("frame", F.posexplode("values").alias("k", "v")).withColumn("k", F.col("k").cast("long"))


# --------------------------------------------------------------------------- spectra
def _band_sql(edges: list[int], most: int) -> str:
    return "bands(band, lo, hi) AS (VALUES " + ", ".join(f"({b}, {edges[b]}, {edges[b + 1]})" for b in range(len(edges) - 1) if edges[b] < most) + ")"


_PRE = "[" + ", ".join(map(str, spectral.PRETAB)) + "]"


@query(f"""WITH {SPEC}, {_band_sql(spectral.LONG_44, 64)}, q AS (SELECT frame, k, CAST(round_even(x * 200, 0) AS INTEGER) AS q FROM spec)
SELECT frame, k, band, CAST(greatest(-32768, least(32767, round_even(4096 * sign(q) * pow(least(abs(q), 8206), 4.0 / 3.0) * pow(2.0, ((190 + frame % 30) - 210) * 0.25) * pow(2.0, -(CASE WHEN frame % 2 = 0 THEN 0.5 ELSE 1.0 END) * ((band + frame) % 16 + (frame // 2) % 2 * {_PRE}[band + 1])), 0))) AS INTEGER) AS s FROM q JOIN bands ON k >= lo AND k < hi""")
def requantize_bands(spark, sf):
    f = F.col("frame")
    q = signals.spec(spark, sf).select("frame", "k", F.rint(F.col("x") * 200).cast("int").alias("q"), (190 + f % 30).alias("global_gain"), F.when(f % 2 == 0, 0).otherwise(1).alias("scale"), (F.floor(f / 2) % 2).alias("preflag"), F.transform(F.sequence(F.lit(0), F.lit(21)), lambda b: ((b + f) % 16).cast("int")).alias("sf"))
    return spectral.requantize(q).select("frame", "k", "band", full_scale("x", 4096).alias("s"))


_BUT = ", ".join(f"({i}, {cs}, {ca})" for i, (cs, ca) in enumerate(spectral.butterfly_terms()))


@query(f"""WITH {SPEC}, t(i, cs, ca) AS (VALUES {_BUT}), sides AS (SELECT 18 * sb - 1 - i AS lo, 18 * sb + i AS hi, cs, ca FROM t, (VALUES (1), (2)) s(sb)),
e AS (SELECT b.frame, lo, hi, b.x * cs - u.x * ca AS xl, u.x * cs + b.x * ca AS xu FROM sides JOIN spec b ON b.k = lo JOIN spec u ON u.k = hi AND u.frame = b.frame)
SELECT frame, CAST(lo AS INTEGER) AS k, round(xl, 8) + 0.0 AS x FROM e UNION ALL SELECT frame, CAST(hi AS INTEGER), round(xu, 8) + 0.0 FROM e
UNION ALL SELECT frame, k, round(x, 8) + 0.0 FROM spec WHERE k NOT IN (SELECT lo FROM sides UNION SELECT hi FROM sides)""")
def antialias_butterfly(spark, sf):
    return spectral.antialias(signals.spec(spark, sf), 3).select("frame", "k", F.round("x", 8).alias("x"))


@query(f"WITH {SPEC} SELECT frame, k, round(CASE WHEN (k // 18) % 2 = 1 AND (k % 18) % 2 = 1 THEN -x ELSE x END, 8) + 0.0 AS x FROM spec")
def freq_inversion(spark, sf):
    return spectral.invert_frequencies(signals.spec(spark, sf)).withColumn("x", F.round("x", 8))


_SHORT = spectral.SHORT_44
_PERM = ", ".join(f"({3 * _SHORT[b] + w * (_SHORT[b + 1] - _SHORT[b]) + j}, {3 * _SHORT[b] + 3 * j + w})" for b in range(13) for w in range(3) for j in range(_SHORT[b + 1] - _SHORT[b]) if 3 * _SHORT[b] + w * (_SHORT[b + 1] - _SHORT[b]) + j < 64)


@query(f"WITH {SPEC}, p(k, k2) AS (VALUES {_PERM}) SELECT frame, CAST(k2 AS INTEGER) AS k, round(x, 8) + 0.0 AS x FROM spec JOIN p USING (k)")
def reorder_short(spark, sf):
    return spectral.reorder_short(signals.spec(spark, sf)).withColumn("x", F.round("x", 8))


IMDCT = f"{SPEC}, blk AS (SELECT frame, i, sum(x * cos(2 * pi() / 128 * (i + 0.5 + 32) * (k + 0.5))) AS y FROM spec, range(128) t(i) GROUP BY 1, 2)"


def _imdct(spark, sf):
    return spectral.imdct(signals.spec(spark, sf), 128)


@query(f"WITH {IMDCT} SELECT frame, CAST(i AS INTEGER) AS i, {_clamp('y * 8192')} AS s FROM blk")
def imdct_direct(spark, sf):
    return _imdct(spark, sf).select("frame", "i", full_scale("y", 8192).alias("s"))


@query(f"WITH {IMDCT} SELECT CAST(frame + i // 64 AS BIGINT) AS frame, CAST(i % 64 AS INTEGER) AS i, {_clamp('sum(y) * 4096')} AS s FROM blk GROUP BY 1, 2 HAVING min(i // 64) = 0")
def overlap_add(spark, sf):
    return spectral.overlap_add(_imdct(spark, sf), 128).select("frame", F.col("i").cast("int").alias("i"), full_scale("y", 4096).alias("s"))


@query(f"""WITH {SPEC}, g AS (SELECT frame // 16 AS stream_id, frame % 16 AS block, CASE WHEN frame % 3 = 0 THEN 32 ELSE 64 END AS n, list(x ORDER BY k) AS y FROM spec GROUP BY frame),
b AS (SELECT *, lag(n) OVER w AS pn, lag(y) OVER w AS py FROM g WINDOW w AS (PARTITION BY stream_id ORDER BY block)),
c AS (SELECT *, (pn + n) // 4 AS size, CAST(floor((n - pn) / 4.0) AS BIGINT) AS off FROM b WHERE pn IS NOT NULL),
d AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY stream_id ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM c),
e AS (SELECT *, unnest(range(size)) AS a FROM d)
SELECT stream_id, CAST(base + a AS BIGINT) AS pos, round((CASE WHEN a < pn - pn // 2 THEN py[pn // 2 + a + 1] ELSE 0 END) + (CASE WHEN a + off >= 0 AND a + off < n THEN y[a + off + 1] ELSE 0 END), 8) + 0.0 AS y FROM e""")
def lap_variable(spark, sf):
    e = signals.table(spark, sf, "embeddings")
    n = F.when(F.col("vec_id") % 3 == 0, 32).otherwise(64)
    b = e.select(F.floor(F.col("vec_id") / 16).alias("stream_id"), (F.col("vec_id") % 16).alias("block"), n.alias("n"), F.slice(F.col("embedding").cast("array<double>"), F.lit(1), n).alias("y"))
    return spectral.lap_variable(b).withColumn("y", F.round("y", 8))


@query(f"WITH {SPEC}, e AS (SELECT *, sum(x * x) OVER (PARTITION BY frame, k // 8) AS e FROM spec) SELECT frame, k, CAST(k // 8 AS INTEGER) AS band, round(CASE WHEN e > 0 THEN x / sqrt(e) ELSE 0 END, 8) + 0.0 AS x FROM e")
def energy_normalise(spark, sf):
    s = signals.spec(spark, sf).withColumn("band", F.floor(F.col("k") / 8).cast("int"))
    return spectral.normalise_energy(s).select("frame", "k", "band", F.round("x", 8).alias("x"))


@query(f"WITH {SPEC} SELECT frame, ch, k, round(x * pow(2, -((frame + k // 8 + ch) % 5)), 10) + 0.0 AS x FROM spec, (VALUES (0), (1)) c(ch)")
def channel_coupling(spark, sf):
    s = signals.spec(spark, sf).withColumn("band", F.floor(F.col("k") / 8).cast("int"))
    co = s.select("frame", "band").distinct().withColumn("ch", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("coord", F.pow(F.lit(2.0), -((F.col("frame") + F.col("band") + F.col("ch")) % 5)))
    return spectral.couple(s, co).withColumn("x", F.round("x", 10))


@query(f"WITH {SPEC} SELECT frame, k, round(x * pow(2, (frame + k // 8) % 4), 8) + 0.0 AS x FROM spec")
def denormalise_bands(spark, sf):
    s = signals.spec(spark, sf).withColumn("band", F.floor(F.col("k") / 8).cast("int"))
    e = s.select("frame", "band").distinct().withColumn("e", (F.col("frame") + F.col("band")) % 4)
    return spectral.denormalise(s, e).withColumn("x", F.round("x", 8))


@query(f"WITH {SPEC} SELECT a.frame, a.k, round(CASE WHEN a.k % 2 = 0 THEN a.x + b.x ELSE b.x - a.x END * pow(2, -0.5), 8) + 0.0 AS x FROM spec a JOIN spec b ON b.frame = a.frame AND b.k = CASE WHEN a.k % 2 = 0 THEN a.k + 1 ELSE a.k - 1 END")
def haar1(spark, sf):
    return spectral.haar(signals.spec(spark, sf)).select("frame", "k", F.round("x", 8).alias("x"))


@query(f"WITH {SPEC} SELECT frame AS step, CAST(i AS INTEGER) AS i, round(sum(x * cos((16 + i) * (2 * k + 1) * pi() / 64)), 6) + 0.0 AS v FROM spec, range(64) t(i) WHERE k < 32 GROUP BY 1, 2")
def polyphase_matrix(spark, sf):
    return spectral.polyphase_matrix(signals.spec(spark, sf).filter("k < 32").withColumnRenamed("frame", "step")).withColumn("v", F.round("v", 6))


_WIN0 = "sin(pi() / 36 * (p + 0.5))"


@query(f"WITH {SPEC} SELECT frame, CAST(k // 18 AS INTEGER) AS sb, CAST(p AS INTEGER) AS i, round({_WIN0} * sum(x * cos(pi() / 72 * (2 * p + 1 + 18) * (2 * (k % 18) + 1))), 6) + 0.0 AS y FROM spec, range(36) t(p) WHERE k < 54 GROUP BY 1, 2, p")
def imdct36_window(spark, sf):
    s = signals.spec(spark, sf).filter("k < 54").select("frame", F.floor(F.col("k") / 18).cast("int").alias("sb"), (F.col("k") % 18).cast("int").alias("m"), "x")
    return spectral.imdct36(s).withColumn("y", F.round("y", 6))


@query(f"WITH {SPEC}, b(band, lo, hi) AS (VALUES " + ", ".join(f"({b}, {lo}, {hi})" for b, (lo, hi) in enumerate([(i, i + 1) for i in range(28)] + [(28 + 3 * i, 31 + 3 * i) for i in range(7)] + [(49, 55), (55, 61), (61, 67)])) + ") SELECT frame, band, round(sum(x * x), 10) + 0.0 AS energy, count(*) AS lines FROM spec JOIN b ON k >= lo AND k < hi GROUP BY 1, 2")
def bark_bands(spark, sf):
    edges = [*range(28), *range(28, 50, 3), 55, 61, 67]
    dim = F.broadcast(spectral.band_table(spark, edges))
    return signals.spec(spark, sf).join(dim, "k").groupBy("frame", "band").agg(F.round(F.sum(F.col("x") * F.col("x")), 10).alias("energy"), F.count("*").alias("lines"))


@query("WITH s AS (SELECT vec_id, CAST(round_even(embedding[1] * 200, 0) AS INTEGER) AS y0, CAST(round_even(embedding[2] * 200, 0) AS INTEGER) AS y1, CAST(8 + vec_id % 24 AS INTEGER) AS w FROM embeddings), t AS (SELECT *, unnest(range(w)) AS dx FROM s) SELECT vec_id, CAST(vec_id + dx AS BIGINT) AS x, CAST(y0 + CAST(trunc(((y1 - y0) * dx) / CAST(w AS DOUBLE)) AS BIGINT) AS BIGINT) AS y FROM t")
def floor_render_line(spark, sf):
    e = signals.table(spark, sf, "embeddings")
    y = lambda i: F.rint(F.get("embedding", F.lit(i)) * F.lit(200).cast("float")).cast("long")  # noqa: E731  # single precision, as in the SQL
    seg = e.select("vec_id", F.col("vec_id").alias("x0"), (F.col("vec_id") + 8 + F.col("vec_id") % 24).alias("x1"), y(0).alias("y0"), y(1).alias("y1"))
    return spectral.render_line(seg).select("vec_id", "x", "y")


@query(f"""WITH {SPEC}, p AS (SELECT frame, list(CAST(3072 - ((CAST(round_even(abs(x) * 40, 0) AS INTEGER) % 25) << 7) AS INTEGER) ORDER BY k) AS p FROM spec GROUP BY 1)
SELECT frame, list_reduce(p, lambda a, x: CAST(greatest(a, x) + floor(1280 / 6.0 * log10(1 + pow(10.0, -6 * least(greatest(a, x) - ((a + x) >> 1), 255) / 640.0))) AS INTEGER)) AS level FROM p""")
def psd_log_add(spark, sf):
    p = signals.table(spark, sf, "embeddings").select(F.col("vec_id").alias("frame"), F.transform("embedding", lambda x: (3072 - (F.rint(F.abs(x.cast("double")) * 40).cast("int") % 25) * 128).cast("int")).alias("psd"))
    return packets.log_add(p).select("frame", "level")


# --------------------------------------------------------------------------- bytes
def _crc_sql(width: int, poly: int) -> str:
    t = "[" + ", ".join(map(str, bits.crc_table(width, poly))) + "]"
    return f"WITH {BYTES} SELECT doc_id, list_reduce(list_prepend(0, b), lambda c, x: CAST(xor({t}[xor(c >> {width - 8}, x) + 1], (c & {(1 << (width - 8)) - 1}) * 256) AS INTEGER)) AS crc FROM bytes"


@query(_crc_sql(8, 0x07))
def crc8(spark, sf):
    return raw(spark, sf).select("doc_id", bits.crc8(bits.byte_array("b")).alias("crc"))


@query(_crc_sql(16, 0x8005))
def crc16(spark, sf):
    return raw(spark, sf).select("doc_id", bits.crc16(bits.byte_array("b")).alias("crc"))


@query("SELECT doc_id, md5(text) AS md5 FROM documents WHERE text IS NOT NULL")
def md5_stream(spark, sf):
    return raw(spark, sf).select("doc_id", F.md5("b").alias("md5"))


@query(f"WITH {HEADS} SELECT doc_id, b0 * 256 + b1 AS u16, ((b0 * 256 + b1) * 256 + b2) * 256 + b3 AS u32, (b0 >> 3) & 31 AS top5, ((b1 * 256 + b2) >> 4) & 255 AS mid8, CASE WHEN b2 >= 128 THEN b2 - 256 ELSE b2 END AS s8 FROM head WHERE b3 IS NOT NULL")
def bit_fields_be(spark, sf):
    r = raw(spark, sf).filter(F.octet_length("b") >= 4)
    return r.select("doc_id", bits.unsigned_be("b", 0, 2).alias("u16"), word32().alias("u32"), bits.bit_field(bits.byte_at("b", 0), 3, 5).alias("top5"), bits.bit_field(bits.unsigned_be("b", 1, 2), 4, 8).alias("mid8"), bits.sign_extend(bits.byte_at("b", 2).cast("long"), 8).alias("s8"))


@query(f"WITH {HEADS} SELECT doc_id, b0 + b1 * 256 AS u16, b0 + b1 * 256 + b2 * 65536 + b3 * 16777216 AS u32, (b0 + b1 * 256) & 31 AS low5, ((b0 + b1 * 256) >> 5) & 127 AS next7 FROM head WHERE b3 IS NOT NULL")
def bit_fields_le(spark, sf):
    r = raw(spark, sf).filter(F.octet_length("b") >= 4)
    two = bits.unsigned_le("b", 0, 2)
    return r.select("doc_id", two.alias("u16"), bits.unsigned_le("b", 0, 4).alias("u32"), bits.bit_field(two, 0, 5).alias("low5"), bits.bit_field(two, 5, 7).alias("next7"))


@query(f"WITH {HEADS} SELECT doc_id, (CASE WHEN w % 2 = 0 THEN w // 2 ELSE -(w // 2) - 1 END) AS r FROM (SELECT doc_id, ((b0 * 256 + b1) * 256 + b2) * 256 + b3 AS w FROM head WHERE b3 IS NOT NULL)")
def zigzag_rice_unfold(spark, sf):
    return raw(spark, sf).filter(F.octet_length("b") >= 4).select("doc_id", bits.unfold_zigzag(word32()).alias("r"))


@query(f"WITH {HEADS} SELECT doc_id, CAST(CASE WHEN b0 < 128 THEN b0 WHEN b0 & 224 = 192 AND b1 & 192 = 128 THEN (b0 & 31) * 64 + (b1 & 63) WHEN b0 & 240 = 224 AND b1 & 192 = 128 AND b2 & 192 = 128 THEN (b0 & 15) * 4096 + (b1 & 63) * 64 + (b2 & 63) END AS INTEGER) AS value FROM head")
def coded_number(spark, sf):
    return raw(spark, sf).select("doc_id", bits.coded_number("b").cast("int").alias("value"))  # a character has 21 bits at most


@query(f"WITH {WORD} SELECT doc_id, CAST(length(bin(w)) AS INTEGER) AS ilog, CASE WHEN w >> 31 = 1 THEN -(w & 2097151) ELSE w & 2097151 END * pow(2.0, ((w >> 21) & 1023) - 788) AS f FROM w")
def vorbis_numbers(spark, sf):
    return raw(spark, sf).filter(F.octet_length("b") >= 4).select("doc_id", bits.ilog(word32()).alias("ilog"), bits.float32_unpack(word32()).alias("f"))


@query("WITH p AS (SELECT p_partkey, CAST(1 + p_partkey % 10000 AS INTEGER) AS e, CAST(1 + p_size % 6 AS INTEGER) AS d FROM part) SELECT p_partkey, e, d, (SELECT CAST(max(r) AS INTEGER) FROM range(10001) t(r) WHERE pow(r, d) <= e) AS r FROM p")
def lookup1_values(spark, sf):
    p = signals.table(spark, sf, "part").select("p_partkey", (1 + F.col("p_partkey") % 10000).cast("int").alias("e"), (1 + F.col("p_size") % 6).cast("int").alias("d"))
    return p.select("p_partkey", "e", "d", bits.lookup1_values("e", "d", 10000).alias("r"))


# --------------------------------------------------------------------------- headers
def _fake_word(w):
    """Sync bits set, so that headers of all kinds occur."""
    return w.bitwiseOR(F.lit(0xFFE00000))


_RATES = {n: "[" + ", ".join(map(str, v)) + "]" for n, v in (("l3", headers.L3_RATES), ("l2", headers.L2_RATES), ("lsf", headers.LSF_RATES))}


def _mpeg_sql(layer: int) -> str:
    own = _RATES["l2" if layer == 2 else "l3"]
    samples = "1152" if layer == 2 else "CASE WHEN v = 3 THEN 1152 ELSE 576 END"
    return f"""WITH {WORD}, x AS (SELECT doc_id, w | 4292870144 AS w FROM w),
f AS (SELECT doc_id, (w >> 19) & 3 AS v, 4 - ((w >> 17) & 3) AS lay, (w >> 12) & 15 AS br, (w >> 10) & 3 AS sr, (w >> 6) & 3 AS mode, (w >> 9) & 1 AS pad, (w >> 4) & 3 AS ext, 1 - ((w >> 16) & 1) AS crc FROM x),
g AS (SELECT *, 1000 * CASE WHEN v = 3 THEN {own}[br + 1] ELSE {_RATES['lsf']}[br + 1] END AS bitrate, [44100, 48000, 32000][sr + 1] // CASE WHEN v = 3 THEN 1 WHEN v = 2 THEN 2 ELSE 4 END AS rate, {samples} AS samples FROM f WHERE v <> 1 AND lay = {layer} AND br NOT IN (0, 15) AND sr <> 3)
SELECT doc_id, CASE WHEN v = 3 THEN 'mpeg1' WHEN v = 2 THEN 'mpeg2' ELSE 'mpeg25' END AS version, CAST(crc AS INTEGER) AS crc, CAST(bitrate AS INTEGER) AS bitrate, CAST(rate AS INTEGER) AS sample_rate, CAST(mode AS INTEGER) AS mode, CAST(ext AS INTEGER) AS mode_extension, CAST(CASE WHEN mode = 3 THEN 1 ELSE 2 END AS INTEGER) AS channels, CAST(samples AS INTEGER) AS samples,
CAST(CASE WHEN samples = 1152 THEN 144 ELSE 72 END * bitrate // rate + pad AS INTEGER) AS frame_length, CAST(CASE WHEN v = 3 THEN 0 WHEN v = 2 THEN 3 ELSE 6 END + sr AS INTEGER) AS band_table FROM g"""


def _mpeg(layer: int):
    def run(spark, sf):
        h = raw(spark, sf).filter(F.octet_length("b") >= 4).select("doc_id", headers.mpeg_header(_fake_word(word32()), layer).alias("h")).filter("h IS NOT NULL")
        return h.select("doc_id", *[f"h.{c}" for c in ("version", "crc", "bitrate", "sample_rate", "mode", "mode_extension", "channels", "samples", "frame_length", "band_table")])

    query(_mpeg_sql(layer), "mpeg_header_parse" if layer == 3 else "mpeg_header_layer2")(run)


_mpeg(3)
_mpeg(2)


@query(f"""WITH {HEADS}, c AS (SELECT doc_id, b0, (b0 >> 3) & 31 AS c FROM head WHERE b0 IS NOT NULL)
SELECT doc_id, CAST(c AS INTEGER) AS config, CASE WHEN c < 12 THEN 'silk' WHEN c < 16 THEN 'hybrid' ELSE 'celt' END AS mode,
CASE WHEN c < 4 THEN 'nb' WHEN c < 8 THEN 'mb' WHEN c < 12 THEN 'wb' WHEN c < 14 THEN 'swb' WHEN c < 16 THEN 'fb' WHEN c < 20 THEN 'nb' WHEN c < 24 THEN 'wb' WHEN c < 28 THEN 'swb' ELSE 'fb' END AS bandwidth,
CAST(CASE WHEN c >= 16 THEN [120, 240, 480, 960][c % 4 + 1] WHEN c >= 12 THEN [480, 960][c % 2 + 1] ELSE [480, 960, 1920, 2880][c % 4 + 1] END AS INTEGER) AS frame_size, b0 & 4 <> 0 AS stereo, CAST(b0 & 3 AS INTEGER) AS code FROM c""")
def toc_parse(spark, sf):
    return raw(spark, sf).filter(F.octet_length("b") >= 1).select("doc_id", headers.opus_toc(bits.byte_at("b", 0)).alias("t")).select("doc_id", "t.*")


_KBPS = "[" + ", ".join(map(str, headers.AC3_KBPS)) + "]"


@query(f"""WITH {HEADS}, f AS (SELECT doc_id, b4 >> 6 AS r, b4 & 63 AS z FROM head WHERE b5 IS NOT NULL), g AS (SELECT doc_id, r, z, {_KBPS}[z // 2 + 1] AS k FROM f WHERE r <> 3 AND z <= 37)
SELECT doc_id, CAST(2 * CASE r WHEN 0 THEN 2 * k WHEN 1 THEN k * 96000 // 44100 + z % 2 ELSE 3 * k END AS INTEGER) AS frame_length FROM g""")
def ac3_frame_length(spark, sf):
    r = raw(spark, sf).filter(F.octet_length("b") >= 6)
    framed = F.concat(F.unhex(F.lit("0B77")), F.substring("b", 3, 3), F.unhex(F.lit("40")))
    return r.select("doc_id", headers.ac3_frame_length(framed).alias("frame_length")).filter("frame_length IS NOT NULL")


@query(f"WITH {HEADS} SELECT doc_id, CAST((b2 >> 2) & 15 AS INTEGER) AS rate_index, CAST((b2 & 1) * 4 + (b3 >> 6) AS INTEGER) AS channel_config, CAST((b3 & 3) * 2048 + b4 * 8 + (b5 >> 5) AS INTEGER) AS frame_length, CAST(CASE WHEN b1 % 2 = 1 THEN 7 ELSE 9 END AS INTEGER) AS header_length, CAST((b2 >> 6) + 1 AS INTEGER) AS object_type FROM head WHERE b7 IS NOT NULL")
def adts_header_parse(spark, sf):
    r = raw(spark, sf).filter(F.octet_length("b") >= 8)
    framed = F.concat(F.unhex(F.lit("FF")), F.when(bits.byte_at("b", 1) % 2 == 1, F.unhex(F.lit("F1"))).otherwise(F.unhex(F.lit("F0"))), F.expr("substring(b, 3)"))
    return r.select("doc_id", headers.adts_header(framed).alias("h")).select("doc_id", "h.*")


@query(f"WITH {BYTES}, p AS (SELECT doc_id, unnest(range(len(b) - 1)) AS pos, b FROM bytes WHERE len(b) > 1) SELECT doc_id, pos FROM p WHERE b[pos + 1] = 32 AND b[pos + 2] & 224 = 96")
def sync_scan(spark, sf):
    """Offsets of two-byte sync patterns: a byte array's neighbours, filtered before they become rows."""
    b = raw(spark, sf).select("doc_id", bits.byte_array("b").alias("v")).filter(F.size("v") > 1)
    hits = F.zip_with("v", F.slice("v", F.lit(2), F.size("v")), lambda x, y: (x == 32) & (y.bitwiseAND(224) == 96))
    return b.select("doc_id", F.posexplode(hits).alias("pos", "hit")).filter("hit").select("doc_id", F.col("pos").cast("long").alias("pos"))


_SEGS = "seg AS (SELECT l_orderkey AS stream_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_extendedprice) - 1 AS seg, CASE WHEN l_quantity > 25 THEN 255 ELSE CAST(l_quantity AS INTEGER) END AS size FROM lineitem)"


def _segments(spark, sf):
    l = signals.table(spark, sf, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_extendedprice")
    return l.select(F.col("l_orderkey").alias("stream_id"), (F.row_number().over(w) - 1).alias("seg"), F.when(F.col("l_quantity") > 25, 255).otherwise(F.col("l_quantity").cast("int")).alias("size"))


@query(f"WITH {_SEGS}, p AS (SELECT *, coalesce(sum(CASE WHEN size < 255 THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS packet_no FROM seg) SELECT stream_id, CAST(packet_no AS BIGINT) AS packet_no, CAST(sum(size) AS BIGINT) AS size, bool_or(size < 255) AS complete FROM p GROUP BY 1, 2")
def xiph_lacing(spark, sf):
    return packets.lace(_segments(spark, sf))


@query("WITH c AS (SELECT o_custkey % 50 AS stream_id, o_orderkey AS chunk FROM orders), e AS (SELECT c_custkey % 50 AS stream_id, c_custkey * 9 AS first_chunk, 1 + c_nationkey % 7 AS per_chunk FROM customer) SELECT c.stream_id, c.chunk, e.per_chunk FROM c ASOF LEFT JOIN e ON c.stream_id = e.stream_id AND c.chunk >= e.first_chunk")
def stsc_asof(spark, sf):
    c = signals.table(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("stream_id"), F.col("o_orderkey").alias("chunk"))
    e = signals.table(spark, sf, "customer").select((F.col("c_custkey") % 50).alias("stream_id"), (F.col("c_custkey") * 9).alias("first_chunk"), (1 + F.col("c_nationkey") % 7).alias("per_chunk"))
    return packets.asof(c, e, ["stream_id"], "chunk", "first_chunk", ["per_chunk"]).select("stream_id", "chunk", "per_chunk")


@query("WITH s AS (SELECT l_orderkey AS chunk, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_extendedprice) AS i, CAST(l_quantity AS BIGINT) AS size FROM lineitem) SELECT chunk, i, size, CAST(coalesce(sum(size) OVER (PARTITION BY chunk ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM s")
def sample_offsets(spark, sf):
    l = signals.table(spark, sf, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_extendedprice")
    s = l.select(F.col("l_orderkey").alias("chunk"), F.row_number().over(w).cast("long").alias("i"), F.col("l_quantity").cast("long").alias("size"))
    return packets.sample_offsets(s)


# --------------------------------------------------------------------------- metrics
@query(f"""WITH {SIG}, b AS (SELECT stream_id, n + 7 AS m, s FROM sig), x AS (SELECT a.stream_id, l.lag, sum(CAST(a.s AS BIGINT) * b.s) AS ab, sum(CAST(a.s AS BIGINT) * a.s) AS aa, sum(CAST(b.s AS BIGINT) * b.s) AS bb FROM sig a, range(-12, 13) l(lag), b WHERE b.stream_id = a.stream_id AND b.m = a.n + l.lag GROUP BY 1, 2)
SELECT stream_id, CAST(arg_max(lag, r) AS INTEGER) AS lag, round(max(r), 8) + 0.0 AS r FROM (SELECT *, ab / (sqrt(aa) * sqrt(bb)) AS r FROM x) GROUP BY 1""")
def best_lag(spark, sf):
    s = signals.sig(spark, sf)
    return metrics.best_lag(s, s.withColumn("n", F.col("n") + 7), 12).withColumn("r", F.round("r", 8))


@query(f"WITH {SIG}, {_MU_SQL}, {_MUD_SQL} SELECT stream_id, round(corr(s, d), 8) + 0.0 AS corr, round(sqrt(avg((s - d) * (s - d))), 6) + 0.0 AS rms, round(sqrt(sum((s - d) * (s - d)) / sum(CAST(s AS BIGINT) * s)), 8) + 0.0 AS relative FROM mud GROUP BY 1")
def corr_rms(spark, sf):
    p = signals.sig(spark, sf).select("stream_id", F.col("s").alias("a"), g711.mulaw_decode(g711.mulaw_encode("s")).alias("b"))
    return metrics.compare(p).select("stream_id", F.round("corr", 8).alias("corr"), F.round("rms", 6).alias("rms"), F.round("relative", 8).alias("relative"))


@query(f"WITH {SIG} SELECT stream_id, round(2 * sqrt(pow(sum(s * cos(n * 2 * pi() * 440 / 8000)), 2) + pow(sum(s * sin(n * 2 * pi() * 440 / 8000)), 2)) / count(*), 4) + 0.0 AS level FROM sig GROUP BY 1")
def tone_level(spark, sf):
    return metrics.tone_level(signals.sig(spark, sf), 440, 8000).withColumn("level", F.round("level", 4))


@query(f"WITH {SIG} SELECT stream_id, count(*) FILTER (s < 0) AS negative, count(*) FILTER (abs(s) > 16000) AS loud, count(*) FILTER (s = 0) AS silent FROM sig GROUP BY 1")
def coverage_counts(spark, sf):
    return metrics.coverage(signals.sig(spark, sf), ["stream_id"], {"negative": F.col("s") < 0, "loud": F.abs("s") > 16000, "silent": F.col("s") == 0})


# --------------------------------------------------------------------------- fixed point
@query("WITH RECURSIVE g(n, x) AS (SELECT 0, CAST(522133279 AS UBIGINT) UNION ALL SELECT n + 1, (x * 1664525 + 1013904223) % 4294967296 FROM g WHERE n < 6000) SELECT l_orderkey, CAST(count(*) AS BIGINT) AS draws, CAST(max(g.x) AS BIGINT) AS last_max FROM lineitem JOIN g ON g.n = l_orderkey % 6000 GROUP BY 1".replace("l_orderkey % 6000", "l_partkey % 6000"))
def lcg_jump(spark, sf):
    l = signals.table(spark, sf, "lineitem").withColumn("x", fixed.lcg_jump(522133279, F.col("l_partkey") % 6000, bits=13))
    return l.groupBy("l_orderkey").agg(F.count("*").alias("draws"), F.max("x").alias("last_max"))


_FM = "((16384 + {0} * {1}) >> 15)"
_X2 = "((4096 + t * t) >> 13)"


@query(f"WITH t AS (SELECT event_id, event_id % 16384 AS t FROM events), u AS (SELECT event_id, {_X2} AS x FROM t) SELECT event_id, CAST(1 + (32767 - x) + {_FM.format('x', '(-7651 + ' + _FM.format('x', '(8277 + ' + _FM.format('-626', 'x') + ')') + ')')} AS BIGINT) AS c FROM u")
def bitexact_cos(spark, sf):
    return signals.table(spark, sf, "events").select("event_id", fixed.bitexact_cos(F.col("event_id") % 16384).alias("c"))


@query("WITH t AS (SELECT event_id, (event_id * 7919) % 2000003 - 1000000 AS a, (event_id * 104729) % 65536 AS b, event_id % 64 AS i FROM events), u AS (SELECT *, CASE WHEN b >= 32768 THEN b - 65536 ELSE b END AS sb FROM t) SELECT event_id, (a * sb) >> 16 AS smulwb, a + ((a * sb) >> 16) AS smlawb, sb * sb AS smulbb, (a * b) >> 16 AS smulww, ((a >> 3) + 1) >> 1 AS rror4, CAST(32 - length(bin(b + 1)) AS INTEGER) AS clz, CASE WHEN i < 8 THEN i ELSE (8 + (i & 7)) << ((i >> 3) - 1) END AS pulses FROM u")
def silk_fixed_point(spark, sf):
    e = signals.table(spark, sf, "events").select("event_id", ((F.col("event_id") * 7919) % 2000003 - 1000000).alias("a"), ((F.col("event_id") * 104729) % 65536).alias("b"), (F.col("event_id") % 64).alias("i"))
    return e.select("event_id", fixed.smulwb("a", "b").alias("smulwb"), fixed.smlawb("a", "a", "b").alias("smlawb"), fixed.smulbb("b", "b").alias("smulbb"), fixed.smulww("a", "b").alias("smulww"), fixed.round_shift("a", 4).alias("rror4"), fixed.clz32(F.col("b") + 1).alias("clz"), fixed.pulses_of("i").alias("pulses"))


@query("WITH b AS (SELECT event_id, event_id % 256 AS b FROM events) SELECT event_id, pow(2.0, (b >> 5) - 8 * (b >> 7) - 5) * (32 + (b & 31)) AS gain, CAST(b // 25 AS INTEGER) AS d2, CAST(b % 25 // 5 AS INTEGER) AS d1, CAST(b % 5 AS INTEGER) AS d0 FROM b")
def ac3_scalars(spark, sf):
    e = signals.table(spark, sf, "events").select("event_id", (F.col("event_id") % 256).alias("b"))
    d = fixed.ungroup5("b")
    return e.select("event_id", fixed.dynamic_range("b").alias("gain"), d[0].alias("d2"), d[1].alias("d1"), d[2].alias("d0"))


@query(f"WITH {SIG} SELECT stream_id, n, {_clamp('pow(abs(s) % 8207, 4.0 / 3.0) * pow(2.0, (n % 40 - 60) / 4.0)')} AS s FROM sig")
def power_law_gain(spark, sf):
    s = signals.sig(spark, sf)
    return s.select("stream_id", "n", clamp16(F.pow((F.abs("s") % 8207).cast("double"), F.lit(4.0 / 3.0)) * F.pow(F.lit(2.0), (F.col("n") % 40 - 60) / 4.0)).alias("s"))


# --------------------------------------------------------------------------- containers and codebooks
@query("SELECT CAST(doc_id AS VARCHAR) AS stream_id, CAST(0 AS BIGINT) AS packet_no, md5(text) AS payload FROM documents WHERE text IS NOT NULL UNION ALL SELECT CAST(doc_id AS VARCHAR), 1, md5(coalesce(lang, '')) FROM documents WHERE text IS NOT NULL")
def ogg_demux(spark, sf):
    """Documents as two-packet files, laced over pages and taken apart again."""
    from sonaril.sources import demux, mux

    d = signals.table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", F.encode("text", "utf-8").alias("a"), F.encode(F.coalesce("lang", F.lit("")), "utf-8").alias("b"))
    return demux.ogg_packets(mux.ogg_files(d, "doc_id", ["a", "b"])).select("stream_id", "packet_no", F.md5("payload").alias("payload"))


@query("WITH d AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE md5(text) END AS a, CASE WHEN doc_id % 2 = 0 THEN coalesce(lang, '') ELSE md5(coalesce(lang, '')) END AS b FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, unnest([0, 1, 2]) AS sample, unnest([a, b, a]) AS x FROM d) SELECT CAST(doc_id AS VARCHAR) AS stream_id, CAST(sample AS BIGINT) AS sample, CAST(octet_length(encode(x)) AS BIGINT) AS size, md5(x) AS payload FROM p")
def mp4_demux(spark, sf):
    """Documents as three-sample files in chunks of two; those of odd ids have samples of one size."""
    from sonaril.sources import demux, mux

    d = signals.table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("lang"))
    part = lambda c: F.encode(F.when(F.col("doc_id") % 2 == 0, F.col(c)).otherwise(F.md5(F.encode(c, "utf-8"))), "utf-8")
    files = mux.mp4_files(d.select("doc_id", part("text").alias("a"), part("lang").alias("b")), "doc_id", ["a", "b", "a"])
    cut = demux.mp4_samples(files).join(files, "stream_id")
    return cut.select("stream_id", "sample", "size", F.md5(F.substring("content", (F.col("offset") + 1).cast("int"), F.col("size").cast("int"))).alias("payload"))


@query(f"WITH {SIG} SELECT stream_id, n, s FROM sig")
def wav_roundtrip(spark, sf):
    """Streams to WAV bytes and back, in files of 4096 samples."""
    import pyarrow as pa

    from sonaril.sources.wav import parse_wav, wav_bytes

    s = framing.tumbling(signals.sig(spark, sf), 4096).select("stream_id", "frame_no", "samples")

    def run(batches):
        for b in batches:
            back = [parse_wav(wav_bytes(x, 1, 8000))[2] for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(back, pa.list_(pa.int32()))], names=["stream_id", "frame_no", "samples"])

    back = s.mapInArrow(run, "stream_id string, frame_no long, samples array<int>")
    return back.select("stream_id", "frame_no", F.posexplode("samples").alias("i", "s")).select("stream_id", (F.col("frame_no") * 4096 + F.col("i")).alias("n"), "s")


@query("WITH p AS (SELECT p_partkey AS entry, unnest(range(4)) AS d FROM part), v AS (SELECT entry, d, (entry // CAST(pow(6, d) AS BIGINT)) % 6 * 0.25 - 0.5 AS x FROM p) SELECT entry, CAST(d AS INTEGER) AS d, CAST(x AS DOUBLE) AS plain, CAST(sum(x) OVER (PARTITION BY entry ORDER BY d) AS DOUBLE) AS summed FROM v")
def vq_lattice(spark, sf):
    """Vector codebook values of a lattice: mixed-radix digits of the entry, and their running sums."""
    p = signals.table(spark, sf, "part").select(F.col("p_partkey").alias("entry"))
    digits = F.transform(F.array(*[F.lit(6**d) for d in range(4)]), lambda r: (F.floor(F.col("entry") / r) % 6) * F.lit(0.25) - 0.5)
    v = p.select("entry", digits.alias("v"))
    sums = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.aggregate(F.slice("v", F.lit(1), i), F.lit(0.0), lambda a, x: a + x))
    return v.select("entry", F.posexplode(F.arrays_zip(F.col("v").alias("plain"), sums.alias("summed"))).alias("d", "z")).select("entry", "d", "z.plain", "z.summed")


@query("WITH g AS (SELECT event_id // 16 AS block, event_id % 16 AS i, (event_id * 37) % 125 AS v FROM events), d AS (SELECT block, i * 3 + unnest([0, 1, 2]) AS k, unnest([v // 25, v % 25 // 5, v % 5]) - 2 AS d FROM g) SELECT block, CAST(k AS BIGINT) AS k, CAST(12 + sum(d) OVER (PARTITION BY block ORDER BY k) AS BIGINT) AS exponent FROM d")
def ac3_exponents(spark, sf):
    """Grouped base-5 differentials to exponents."""
    e = signals.table(spark, sf, "events").select(F.floor(F.col("event_id") / 16).alias("frame"), (F.col("event_id") % 16).alias("i"), fixed.ungroup5((F.col("event_id") * 37) % 125).alias("g"))
    d = e.select("frame", "i", F.posexplode("g").alias("j", "d")).select("frame", (F.col("i") * 3 + F.col("j")).alias("band"), F.col("d").cast("long").alias("d"))
    return predict.delta_chain(d, 12, 2).select(F.col("frame").alias("block"), F.col("band").alias("k"), F.col("v").alias("exponent"))


# further queries register themselves
from sonaril.plans import filters, heads, pushed, shapes, stages  # noqa: E402, F401
