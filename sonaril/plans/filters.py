"""Queries on recurrences, predictors and filters along streams, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from sonaril.operators import allpass, recurrence, signals, spectral
from sonaril.plans.catalog import PAIRS, SIG, SPEC, STEREO, query


@query(f"""WITH RECURSIVE {SIG}, f(stream_id, n, m, y) AS (SELECT stream_id, n, 0.8500061035 * (s + 1e-30), (s + 1e-30) / 32768 FROM sig WHERE n = 0
UNION ALL SELECT sig.stream_id, sig.n, 0.8500061035 * (sig.s + 1e-30 + f.m), (sig.s + 1e-30 + f.m) / 32768 FROM f JOIN sig ON sig.stream_id = f.stream_id AND sig.n = f.n + 1)
SELECT stream_id, n, round(y, 9) + 0.0 AS y FROM f""")
def deemphasis(spark, sf):
    """One pole along each stream."""
    x = signals.sig(spark, sf).withColumnRenamed("s", "x")
    return recurrence.deemphasis(x).select("stream_id", "n", F.round("y", 9).alias("y"))


@query(f"""WITH RECURSIVE {SIG}, f(stream_id, n, y, y1) AS (SELECT stream_id, n, CAST(s AS DOUBLE), CAST(0 AS DOUBLE) FROM sig WHERE n = 0
UNION ALL SELECT sig.stream_id, sig.n, sig.s + 1.6 * f.y - 0.8 * f.y1, f.y FROM f JOIN sig ON sig.stream_id = f.stream_id AND sig.n = f.n + 1) SELECT stream_id, n, round(y, 4) + 0.0 AS y FROM f""")
def resonator(spark, sf):
    """A recurrence of order two along each stream."""
    x = signals.sig(spark, sf).withColumnRenamed("s", "x")
    return recurrence.linear_recurrence(x, [1.6, -0.8]).select("stream_id", "n", F.round("y", 4).alias("y"))


_LPC = "CASE WHEN frame % 2 = 0 THEN [1500, -700] ELSE [900, 300, -450] END"


@query(f"""WITH RECURSIVE {SIG}, r AS (SELECT stream_id, n // 256 AS frame, n % 256 AS i, s % 1000 AS r FROM sig),
f(stream_id, frame, i, y, y1, y2) AS (SELECT stream_id, frame, i, CAST(r AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM r WHERE i = 0
UNION ALL SELECT r.stream_id, r.frame, r.i, CAST(r.r + CASE WHEN r.frame % 2 = 0 AND r.i >= 2 THEN floor((1500 * f.y - 700 * f.y1) / 1024.0) WHEN r.frame % 2 = 1 AND r.i >= 3 THEN floor((900 * f.y + 300 * f.y1 - 450 * f.y2) / 1024.0) ELSE 0 END AS BIGINT), f.y, f.y1
FROM f JOIN r ON r.stream_id = f.stream_id AND r.frame = f.frame AND r.i = f.i + 1)
SELECT stream_id, frame * 256 + i AS n, y AS s FROM f""")
def lpc_restore(spark, sf):
    """Residuals in frames of 256 to samples, by coefficients of two orders."""
    s = signals.sig(spark, sf).select("stream_id", F.floor(F.col("n") / 256).alias("frame"), (F.col("n") % 256).alias("i"), (F.col("s") % 1000).alias("r"))
    frames = s.groupBy("stream_id", "frame").agg(F.array_sort(F.collect_list(F.struct("i", "r"))).alias("r"))
    even = F.col("frame") % 2 == 0
    ready = frames.select("stream_id", "frame", F.transform("r", lambda v: v["r"]).alias("r"), F.when(even, F.array(F.lit(1500), F.lit(-700))).otherwise(F.array(F.lit(900), F.lit(300), F.lit(-450))).alias("coeffs"), F.lit(10).alias("shift"))
    back = recurrence.lpc_restore(ready).select("stream_id", "frame", F.posexplode("s").alias("i", "s"))
    return back.select("stream_id", (F.col("frame") * 256 + F.col("i")).alias("n"), "s")


@query(f"""WITH {SIG}, r AS (SELECT stream_id, n, s, n % 256 AS i, lag(s, 1) OVER w AS a, lag(s, 2) OVER w AS b FROM sig WINDOW w AS (PARTITION BY stream_id, n // 256 ORDER BY n))
SELECT stream_id, n, CAST(CASE WHEN i < 2 THEN s ELSE s - floor((1500 * a - 700 * b) / 1024.0) END AS BIGINT) AS r FROM r""")
def lpc_residual(spark, sf):
    """What prediction of order two leaves of frames of 256."""
    s = signals.sig(spark, sf).select("stream_id", F.floor(F.col("n") / 256).alias("frame"), (F.col("n") % 256).alias("i"), "s")
    frames = s.groupBy("stream_id", "frame").agg(F.array_sort(F.collect_list(F.struct("i", "s"))).alias("v")).select("stream_id", "frame", F.transform("v", lambda v: v["s"]).alias("v"))
    left = frames.select("stream_id", "frame", F.posexplode(recurrence.lpc_residual(F.col("v"), F.array(F.lit(1500), F.lit(-700)), F.lit(10))).alias("i", "r"))
    return left.select("stream_id", (F.col("frame") * 256 + F.col("i")).alias("n"), "r")


_TAPS = "[[0.3066406250, 0.2170410156, 0.1296386719], [0.4638671875, 0.2680664062, 0.0], [0.7998046875, 0.1000976562, 0.0]]"


def _lagged(lag: str, gain: str, taps: str) -> str:
    at = lambda d: f"f.h[65 - ({lag}) + ({d})]"
    g = lambda i: f"CAST({_TAPS}[{taps} + 1][{i}] AS DOUBLE)"
    return f"{gain} * ({g(1)} * {at(0)} + {g(2)} * ({at(1)} + {at(-1)}) + {g(3)} * ({at(2)} + {at(-2)}))"


def _comb_params(frame):
    """Lag, gain and tap set of a frame; silent for 75 frames in every 150."""
    return [(15 + frame * 7 % 40).cast("int").alias("period"), F.when(frame % 150 < 75, (frame % 4) * 0.2).otherwise(0.0).alias("gain"), (frame % 3).cast("int").alias("tapset")]


_PARAM = "SELECT stream_id, n, s, n % 16 AS i, 15 + (n // 16) * 7 % 40 AS p1, CASE WHEN (n // 16) % 150 < 75 THEN (n // 16) % 4 * CAST(0.2 AS DOUBLE) ELSE 0 END AS g1, (n // 16) % 3 AS t1, n // 16 - 1 AS o FROM sig"


@query(f"""WITH RECURSIVE {SIG}, a AS ({_PARAM}), p AS (SELECT *, CASE WHEN o >= 0 THEN 15 + o * 7 % 40 ELSE 15 END AS p0, CASE WHEN o >= 0 AND o % 150 < 75 THEN o % 4 * CAST(0.2 AS DOUBLE) ELSE 0 END AS g0, CASE WHEN o >= 0 THEN o % 3 ELSE 0 END AS t0,
CASE WHEN i < 12 THEN pow(sin(pi() / 2 * pow(sin(pi() / 2 * (i + 0.5) / 12), 2)), 2) ELSE 1 END AS w FROM a),
f(stream_id, n, y, h) AS (SELECT stream_id, CAST(-1 AS BIGINT), CAST(0 AS DOUBLE), list_transform(range(64), lambda x: CAST(0 AS DOUBLE)) FROM p WHERE n = 0
UNION ALL SELECT stream_id, n, y, list_append(h[2:64], y) FROM (SELECT p.stream_id, p.n, f.h, p.s + (1 - w) * {_lagged('p0', 'g0', 't0')} + w * {_lagged('p1', 'g1', 't1')} AS y FROM f JOIN p ON p.stream_id = f.stream_id AND p.n = f.n + 1))
SELECT stream_id, n, round(y, 5) + 0.0 AS y FROM f WHERE n >= 0""")
def comb_filter(spark, sf):
    """A pitch comb along each stream, its lag, gain and taps changing every 16 samples."""
    x = signals.sig(spark, sf).withColumnRenamed("s", "x")
    params = x.select("stream_id", F.floor(F.col("n") / 16).alias("frame")).distinct().select("stream_id", "frame", *_comb_params(F.col("frame")))
    return recurrence.comb_filter(x, params, 16, 12).select("stream_id", "n", F.round("y", 5).alias("y"))


# --------------------------------------------------------------------------- fast transforms
@query(f"""WITH {SPEC}, l AS (SELECT frame // 16 AS frame, frame % 16 * 64 + k AS k, x FROM spec)
SELECT frame, CAST(i AS INTEGER) AS i, round(sum(x * cos(2 * pi() / 2048 * (i + 0.5 + 512) * (k + 0.5))), 5) + 0.0 AS y FROM l, range(2048) t(i) GROUP BY 1, 2""")
def imdct_fast(spark, sf):
    """Blocks of 2048 samples from 1024 lines, by the fast transform."""
    s = signals.spec(spark, sf).select(F.floor(F.col("frame") / 16).alias("frame"), (F.col("frame") % 16 * 64 + F.col("k")).cast("int").alias("k"), "x")
    return spectral.imdct(s, 2048).select("frame", F.col("i").cast("int").alias("i"), F.round("y", 5).alias("y"))


# --------------------------------------------------------------------------- voice
def _section(o: int, k: int, c: int, name: str) -> str:
    """Columns of one section: its input ``name``, state s{o}."""
    t = f"((({name} - s{o}) * {c}) >> 16)"
    return f"s{o} + {t} AS u{o}, {name} + {t} AS t{o}"


_DOUBLED = f"""f(stream_id, n, s0, s1, s2, s3, s4, s5, e, o) AS (SELECT stream_id, CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM sig WHERE n = 0
UNION ALL SELECT stream_id, n, t0, t1, u1 + g2, t3, t4, u4 + g5, s2 + g2, s5 + g5 FROM (SELECT *, ((u1 - s2) * 39083) >> 16 AS g2, ((u4 - s5) * 55542) >> 16 AS g5 FROM (SELECT *, {_section(1, 1, 14986, 'u0')}, {_section(4, 1, 25769, 'u3')} FROM (SELECT *, {_section(0, 0, 1746, 'v')}, {_section(3, 0, 6854, 'v')} FROM (SELECT f.*EXCLUDE (n), sig.n, CAST(sig.s AS BIGINT) * 1024 AS v FROM f JOIN sig ON sig.stream_id = f.stream_id AND sig.n = f.n + 1)))))"""
_UP = f"""{_DOUBLED}, up AS (SELECT stream_id, 2 * n + p AS n, greatest(-32768, least(32767, (CASE WHEN p = 0 THEN e ELSE o END + 512) >> 10)) AS s FROM f, range(2) t(p) WHERE n >= 0)"""


@query(f"WITH RECURSIVE {SIG}, {_UP} SELECT stream_id, n, CAST(s AS INTEGER) AS s FROM up")
def allpass_double(spark, sf):
    """Streams at twice their rate by two chains of rounding all-pass sections."""
    return allpass.double_rate(signals.sig(spark, sf))


_TWELFTHS = "[189, -600, 617, 30567, 117, -159, -1070, 29704, 52, 221, -2392, 28276, -4, 529, -3350, 26341, -48, 758, -3956, 23973, -80, 905, -4235, 21254, -99, 972, -4222, 18278, -107, 967, -3957, 15143, -103, 896, -3487, 11950, -91, 773, -2865, 8798, -71, 611, -2143, 5784, -46, 425, -1375, 2996]"


SQL_48K = f"""WITH RECURSIVE {SIG}, {_UP}, c AS (SELECT stream_id, count(*) AS len FROM sig GROUP BY 1), b AS (SELECT stream_id, f * 160 + lo AS lo, least(f * 160 + hi, len) AS hi, f * 960 + lo * 6 AS j0 FROM c, range(len // 160 + 1) t(f), (VALUES (0, 8), (8, 88), (88, 160)) e(lo, hi) WHERE f * 160 + lo < len),
j AS (SELECT stream_id, lo, j0, j, j * 21846 AS x FROM b, range(480) t(j) WHERE j * 21846 < (hi - lo) << 17),
t AS (SELECT stream_id, j0 + j AS n, 2 * lo + (x >> 16) + k - 8 AS p, {_TWELFTHS}[CASE WHEN k < 4 THEN (((x & 65535) * 12) >> 16) * 4 + k ELSE (11 - (((x & 65535) * 12) >> 16)) * 4 + 7 - k END + 1] AS w FROM j, range(8) u(k))
SELECT t.stream_id, t.n, CAST(greatest(-32768, least(32767, (CAST(sum(w * coalesce(up.s, 0)) AS BIGINT) + 16384) >> 15)) AS INTEGER) AS s FROM t LEFT JOIN up ON up.stream_id = t.stream_id AND up.n = t.p GROUP BY 1, 2"""


@query(SQL_48K)
def voice_to_48k(spark, sf):
    """Voice of 8 kHz in frames of 20 ms at 48 kHz."""
    return allpass.raise_rate(signals.sig(spark, sf), 8000)


_WEIGHTS = "p AS (SELECT stream_id, frame, (frame * 1237) % 16000 - 8000 AS p0, (frame * 3571) % 12000 - 6000 AS p1 FROM (SELECT DISTINCT stream_id, n // 80 AS frame FROM pairs))"


@query(f"""WITH {PAIRS}, {_WEIGHTS}, q AS (SELECT *, coalesce(lag(p0) OVER w, 0) AS f0, coalesce(lag(p1) OVER w, 0) AS f1 FROM p WINDOW w AS (PARTITION BY stream_id ORDER BY frame)),
x AS (SELECT stream_id, n, a AS mid, b AS side, coalesce(lag(a, 2) OVER w, 0) AS m2, coalesce(lag(a, 1) OVER w, 0) AS m1, coalesce(lag(b, 1) OVER w, 0) AS s1 FROM pairs WINDOW w AS (PARTITION BY stream_id ORDER BY n)),
r AS (SELECT x.*, CASE WHEN n % 80 < 64 THEN f0 + (n % 80 + 1) * CAST(floor((p0 - f0) * 1024 / 65536.0 + 0.5) AS BIGINT) ELSE p0 END AS w0, CASE WHEN n % 80 < 64 THEN f1 + (n % 80 + 1) * CAST(floor((p1 - f1) * 1024 / 65536.0 + 0.5) AS BIGINT) ELSE p1 END AS w1 FROM x JOIN q ON q.stream_id = x.stream_id AND q.frame = x.n // 80),
e AS (SELECT *, greatest(-32768, least(32767, CAST(floor((s1 * 256 + CAST(floor((m2 + mid + 2 * m1) * 512 * w0 / 65536.0) AS BIGINT) + CAST(floor(m1 * 2048 * w1 / 65536.0) AS BIGINT)) / 256.0 + 0.5) AS BIGINT))) AS e FROM r)
SELECT stream_id, n, CAST(greatest(-32768, least(32767, m1 + e)) AS INTEGER) AS l, CAST(greatest(-32768, least(32767, m1 - e)) AS INTEGER) AS r FROM e""")
def predicted_stereo(spark, sf):
    """Mid and side of frames of 80 samples with weights that ramp over the first 64."""
    s = signals.stereo(spark, sf)
    pairs = s.groupBy("stream_id", "n").agg(F.max(F.when(F.col("ch") == 0, F.col("s"))).alias("mid"), F.max(F.when(F.col("ch") == 1, F.col("s"))).alias("side")).filter("mid IS NOT NULL AND side IS NOT NULL")
    f = F.col("frame")
    weights = pairs.select("stream_id", F.floor(F.col("n") / 80).alias("frame")).distinct().select("stream_id", "frame", ((f * 1237) % 16000 - 8000).alias("p0"), ((f * 3571) % 12000 - 6000).alias("p1"))
    return allpass.unmix_predicted(pairs, weights, 80, 64)


@query(f"""WITH {STEREO}, h AS (SELECT stream_id, n, ch, format('{{:02X}}{{:02X}}{{:02X}}', (s * 3) & 255, ((s * 3) >> 8) & 255, ((s * 3) >> 16) & 255) AS h FROM stereo)
SELECT stream_id, CAST(3 * count(*) AS BIGINT) AS n_bytes, md5(unhex(string_agg(h, '' ORDER BY n, ch))) AS md5 FROM h GROUP BY 1""")
def sample_digest(spark, sf):
    """Digest of each stream's interleaved samples of 20 bits."""
    return allpass.sample_digest(signals.stereo(spark, sf).withColumn("s", F.col("s") * 3), 20)
