"""Queries on spectral stages, playback, fixed-point helpers and streams, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from sonaril.functions import bits, fixed
from sonaril.functions.pcm import full_scale
from sonaril.operators import allocation, floors, framing, packets, signals, spectral
from sonaril.plans import filters
from sonaril.plans.catalog import IMDCT, PAIRS, SIG, SPEC, SPEC_PAIRS, STEREO, WORD, _clamp, _lr, _resample_sql, _spec_pairs, query, raw, word32


# --------------------------------------------------------------------------- windows and transforms
_HYBRID = f"""{SPEC}, h AS (SELECT frame % 8 AS stream_id, frame // 8 AS frame, CAST(k // 18 AS INTEGER) AS sb, p, sin(pi() / 36 * (p + 0.5)) * sum(x * cos(pi() / 72 * (2 * p + 19) * (2 * (k % 18) + 1))) AS y FROM spec, range(36) t(p) WHERE k < 54 GROUP BY frame, 3, p)"""


@query(f"WITH {_HYBRID}, o AS (SELECT stream_id, frame + p // 18 AS frame, sb, CAST(p % 18 AS INTEGER) AS i, y, p // 18 AS late FROM h) SELECT stream_id, CAST(frame AS BIGINT) AS frame, sb, i, round(sum(y), 6) + 0.0 AS y FROM o GROUP BY 1, 2, 3, 4 HAVING min(late) = 0")
def hybrid_overlap(spark, sf):
    s = signals.spec(spark, sf).filter("k < 54").select("frame", F.floor(F.col("k") / 18).cast("int").alias("sb"), (F.col("k") % 18).cast("int").alias("m"), "x")
    y = spectral.imdct36(s).withColumn("stream_id", F.col("frame") % 8).withColumn("frame", F.floor(F.col("frame") / 8))
    return spectral.hybrid_overlap(y).select("stream_id", "frame", "sb", F.col("i").cast("int").alias("i"), F.round("y", 6).alias("y"))


@query(f"WITH {SPEC}, w AS (SELECT w, m, p FROM range(3) a(w), range(6) b(m), range(12) c(p)) SELECT frame, CAST(k // 18 AS INTEGER) AS sb, CAST(6 * w + p + 6 AS INTEGER) AS i, round(sum(x * cos(pi() / 24 * (2 * p + 7) * (2 * m + 1)) * sin(pi() / 12 * (p + 0.5))), 6) + 0.0 AS y FROM spec JOIN w ON k % 18 = w + 3 * m WHERE k < 54 GROUP BY 1, 2, 3")
def imdct12_windows(spark, sf):
    s = signals.spec(spark, sf).filter("k < 54").select("frame", F.floor(F.col("k") / 18).cast("int").alias("sb"), (F.col("k") % 18).cast("int").alias("m"), "x")
    return spectral.imdct12(s).filter("i >= 6 AND i < 30").withColumn("i", F.col("i").cast("int")).withColumn("y", F.round("y", 6))


def _prototype(n: int) -> float:
    """A low-pass of 512 taps under a sine: any window may be given."""
    t = n - 255.5
    return math.sin(math.pi * t / 64) / (math.pi * t) * math.sin(math.pi * (n + 0.5) / 512)


@query(f"""WITH {SPEC}, v AS (SELECT frame % 8 AS stream_id, frame // 8 AS step, i, sum(x * cos((16 + i) * (2 * k + 1) * pi() / 64)) AS v FROM spec, range(64) t(i) WHERE k < 32 GROUP BY frame, i),
d AS (SELECT n, sin(pi() * (n - 255.5) / 64) / (pi() * (n - 255.5)) * sin(pi() * (n + 0.5) / 512) AS w FROM range(512) t(n)),
u AS (SELECT v.stream_id, v.step + back AS step, j, v.v * d.w AS y FROM v JOIN (SELECT j, back, 32 * (back % 2) + j AS i, 32 * back + j AS n FROM range(32) a(j), range(16) b(back)) q USING (i) JOIN d USING (n))
SELECT stream_id, step, CAST(j AS INTEGER) AS j, round(sum(y), 6) + 0.0 AS y FROM u WHERE step <= (SELECT max(step) FROM v WHERE v.stream_id = u.stream_id) GROUP BY 1, 2, 3""")
def synthesis_window(spark, sf):
    s = signals.spec(spark, sf).filter("k < 32").withColumnRenamed("frame", "step")
    v = spectral.polyphase_matrix(s).withColumn("stream_id", F.col("step") % 8).withColumn("step", F.floor(F.col("step") / 8))
    y = spectral.synthesis_window(v, [_prototype(n) for n in range(512)])
    return y.select("stream_id", "step", "j", F.round("y", 6).alias("y"))


_SEQ = "CASE frame % 3 WHEN 0 THEN 'only' WHEN 1 THEN 'start' ELSE 'stop' END"


@query(f"""WITH {IMDCT}, b AS (SELECT frame, {_SEQ} AS sequence, i, y FROM blk)
SELECT frame, sequence, CAST(i AS INTEGER) AS i, round(y * CASE WHEN i < 64 THEN CASE WHEN sequence <> 'stop' THEN sin(pi() / 128 * (i + 0.5)) WHEN i < 28 THEN 0 WHEN i < 36 THEN sin(pi() / 16 * (i - 28 + 0.5)) ELSE 1 END
ELSE CASE WHEN sequence <> 'start' THEN sin(pi() / 128 * (i + 0.5)) WHEN i < 92 THEN 1 WHEN i < 100 THEN sin(pi() / 16 * (i - 92 + 8 + 0.5)) ELSE 0 END END, 8) + 0.0 AS y FROM b""")
def window_sequence(spark, sf):
    long_, short = spectral.sine_window(128), spectral.sine_window(16)
    windows = {name: spectral.long_window(name, long_, long_, short, short) for name in ("only", "start", "stop")}
    name = F.when(F.col("frame") % 3 == 0, "only").when(F.col("frame") % 3 == 1, "start").otherwise("stop")
    y = spectral.imdct(signals.spec(spark, sf), 128).withColumn("sequence", name)
    return spectral.window_sequence(y, windows).select("frame", "sequence", F.col("i").cast("int").alias("i"), F.round("y", 8).alias("y"))


@query(f"""WITH {SPEC}, s AS (SELECT frame, k // 8 AS w, 28 + 4 + 8 * (k // 8) - 4 + n AS i, x * cos(2 * pi() / 16 * (n + 0.5 + 4) * (k % 8 + 0.5)) * sin(pi() / 16 * (n + 0.5)) AS y FROM spec, range(16) t(n))
SELECT frame, CAST(i AS INTEGER) AS i, round(sum(y), 7) + 0.0 AS y FROM s GROUP BY 1, 2""")
def short_block_windows(spark, sf):
    y = spectral.short_blocks(signals.spec(spark, sf), 128, spectral.sine_window(16))
    return y.filter("i >= 28 AND i < 100").select("frame", F.col("i").cast("int").alias("i"), F.round("y", 7).alias("y"))


_KBD = "kb AS (SELECT i, (SELECT sum(pow(pi() * 5 * sqrt(1 - pow(2 * i / 64.0 - 1, 2)) / 2, 2 * j) / pow(gamma(j + 1), 2)) FROM range(50) t(j)) AS b FROM range(65) s(i)), win AS (SELECT i, sqrt(sum(b) OVER (ORDER BY i) / (SELECT sum(b) FROM kb)) AS w FROM kb)"


@query(f"""WITH {SPEC}, {_KBD}, t AS (SELECT frame, k, x, frame % 2 = 1 AS sw FROM spec),
y AS (SELECT frame, i, -2048.0 / 128 * sum(x * cos(2 * pi() / 128 * (i + 0.5 + 32) * (k + 0.5))) AS y FROM t, range(128) r(i) WHERE NOT sw GROUP BY 1, 2
UNION ALL SELECT frame, i + 64 * (k % 2), -2048.0 / 64 * sum(x * cos(2 * pi() / 64 * (i + 0.5 + 16) * (k // 2 + 0.5))) FROM t, range(64) r(i) WHERE sw GROUP BY frame, i, k % 2),
z AS (SELECT frame, y.i, y.y * w AS y FROM y JOIN win ON win.i = CASE WHEN y.i < 64 THEN y.i ELSE 127 - y.i END)
SELECT CAST(frame + i // 64 AS BIGINT) AS frame, CAST(i % 64 AS INTEGER) AS i, round(sum(y), 4) + 0.0 AS y FROM z GROUP BY 1, 2 HAVING min(i // 64) = 0""")
def ac3_transform(spark, sf):
    """Blocks of either kind, windowed and overlapped."""
    s = signals.spec(spark, sf).withColumn("switched", F.col("frame") % 2 == 1)
    y = spectral.switched_transform(s, 128, spectral.kbd_window(128, 5.0))
    return spectral.overlap_add(y, 128).select("frame", F.col("i").cast("int").alias("i"), F.round("y", 4).alias("y"))


def _vorbis_sql(n: int, short: int, left: str, right: str) -> str:
    """The window of n samples; left and right: SQL for the size of the neighbour's slope."""
    slope = lambda at, size: f"sin(pi() / 2 * pow(sin(pi() / 2 * (({at}) + 0.5) / ({size} / 2)), 2))"
    lo, hi = f"({n // 4} - {left} / 4)", f"({3 * n // 4} - {right} / 4)"
    return f"CASE WHEN i < {lo} THEN 0 WHEN i < {lo} + {left} / 2 THEN {slope(f'i - {lo}', left)} WHEN i < {hi} THEN 1 WHEN i < {hi} + {right} / 2 THEN {slope(f'{right} / 2 - 1 - (i - {hi})', right)} ELSE 0 END"


@query(f"WITH {IMDCT}, b AS (SELECT frame, i, y, CASE WHEN frame % 2 = 0 THEN 128 ELSE 32 END AS l, CASE WHEN frame % 3 = 0 THEN 128 ELSE 32 END AS r FROM blk) SELECT frame, CAST(i AS INTEGER) AS i, round(y * {_vorbis_sql(128, 32, 'l', 'r')}, 7) + 0.0 AS y FROM b")
def vorbis_windowed(spark, sf):
    """Long blocks between neighbours of either size."""
    windows = {f"{a:d}{b:d}": spectral.vorbis_window(128, 32, True, a, b) for a in (False, True) for b in (False, True)}
    flag = lambda n: F.when(F.col("frame") % n == 0, "1").otherwise("0")
    y = spectral.imdct(signals.spec(spark, sf), 128).withColumn("sequence", F.concat(flag(2), flag(3)))
    return spectral.window_sequence(y, windows).select("frame", F.col("i").cast("int").alias("i"), F.round("y", 7).alias("y"))


# --------------------------------------------------------------------------- filters and permutations
@query(f"""WITH RECURSIVE {SPEC}, l AS (SELECT frame, max(CASE WHEN k = 60 THEN x END) AS a, max(CASE WHEN k = 61 THEN x END) AS b FROM spec GROUP BY 1),
c AS (SELECT frame, greatest(-0.5, least(0.5, a)) AS a, greatest(-0.5, least(0.5, b)) AS b FROM l),
f(frame, k, y, y1) AS (SELECT frame, 0, x, CAST(0 AS DOUBLE) FROM spec WHERE k = 0
UNION ALL SELECT s.frame, s.k, s.x - f.y * (-c.a + c.b * c.a) - CASE WHEN s.k >= 2 THEN f.y1 * (-c.b) ELSE 0 END, f.y FROM f JOIN spec s ON s.frame = f.frame AND s.k = f.k + 1 AND s.k < 32 JOIN c ON c.frame = f.frame)
SELECT frame, CAST(k AS INTEGER) AS k, round(y, 7) + 0.0 AS y FROM f""")
def tns_all_pole(spark, sf):
    """The first 32 lines through an all-pole filter of two reflection coefficients."""
    e = signals.table(spark, sf, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    part = lambda i: F.greatest(F.lit(-0.5), F.least(F.lit(0.5), F.get("v", F.lit(i))))
    x = e.select(F.col("vec_id").alias("frame"), F.slice("v", F.lit(1), F.lit(32)).alias("x"), F.array(part(60), part(61)).alias("parcor"))
    return spectral.shape_noise(x).select("frame", F.posexplode("x").alias("k", "y")).withColumn("y", F.round("y", 7))


@query(f"""WITH {SPEC}, p AS (SELECT frame, k, x, 0.5 + k // 16 * 0.25 AS scale, CASE WHEN k % 8 = frame % 8 THEN 1 + frame % 3 END AS amp FROM spec), q AS (SELECT *, x / scale AS co FROM p),
r AS (SELECT *, CASE WHEN x = 0 THEN -amp ELSE sign(co) * pow(abs(co), 0.75) + CASE WHEN co > 0 THEN amp ELSE -amp END END AS g FROM q) SELECT frame, k, round(CASE WHEN amp IS NULL THEN x ELSE pow(abs(g), 1.0 / 3.0) * g * scale END, 7) + 0.0 AS x FROM r""")
def pulse_add(spark, sf):
    s = signals.spec(spark, sf).withColumn("scale", 0.5 + F.floor(F.col("k") / 16) * 0.25)
    pulses = s.filter(F.col("k") % 8 == F.col("frame") % 8).select("frame", "k", (1 + F.col("frame") % 3).alias("amp"))
    return spectral.add_pulses(s, pulses).select("frame", "k", F.round("x", 7).alias("x"))


@query(f"WITH {SPEC} SELECT frame, CAST([7, 0, 4, 3, 6, 1, 5, 2][k % 8 + 1] * 8 + k // 8 AS INTEGER) AS k, round(x, 8) + 0.0 AS x FROM spec")
def hadamard_deinterleave(spark, sf):
    return spectral.deinterleave(signals.spec(spark, sf), 8, spectral.hadamard_order(8)).select("frame", "k", F.round("x", 8).alias("x"))


@query(f"WITH {SPEC} SELECT frame, CAST(k % 4 * 16 + k // 4 AS INTEGER) AS k, round(x, 8) + 0.0 AS x FROM spec")
def plain_deinterleave(spark, sf):
    return spectral.deinterleave(signals.spec(spark, sf), 4).select("frame", "k", F.round("x", 8).alias("x"))


@query(f"WITH {SPEC_PAIRS} SELECT frame, k, round((a + b) * pow(2, -0.5), 8) + 0.0 AS l, round((b - a) * pow(2, -0.5), 8) + 0.0 AS r FROM two")
def stereo_split(spark, sf):
    return _lr(spectral.split_channels(_spec_pairs(spark, sf)))


@query(f"""WITH {SPEC_PAIRS}, e AS (SELECT frame, 0.49 + sum(b * b) AS m, 1.4 * sum(a * b) AS c FROM two GROUP BY 1)
SELECT frame, k, round(CASE WHEN least(m - c, m + c) < 0.0006 THEN a ELSE (0.7 * a - b) / sqrt(m - c) END, 7) + 0.0 AS l, round(CASE WHEN least(m - c, m + c) < 0.0006 THEN a ELSE (0.7 * a + b) / sqrt(m + c) END, 7) + 0.0 AS r FROM two JOIN e USING (frame)""")
def stereo_merge(spark, sf):
    m = spectral.merge_channels(_spec_pairs(spark, sf), 0.7)
    return m.select("frame", "k", F.round("l", 7).alias("l"), F.round("r", 7).alias("r"))


@query(f"WITH {SPEC}, q AS (SELECT frame, CAST(k // 16 AS INTEGER) AS band, k % 16 // 4 AS b, CAST(trunc(x * 6) AS INTEGER) AS q FROM spec) SELECT frame, band, CAST(bit_or(CASE WHEN q <> 0 THEN 1 << b ELSE 0 END) AS INTEGER) AS mask FROM q GROUP BY 1, 2")
def collapse_masks(spark, sf):
    q = signals.spec(spark, sf).select("frame", F.floor(F.col("k") / 16).cast("int").alias("band"), (F.col("k") % 16).alias("k"), (F.col("x") * 6).cast("int").alias("q"))
    return spectral.collapse_masks(q, 4)


@query(f"WITH {SPEC}, c AS (SELECT frame, ch, k, x, (k + frame) % 5 AS bits FROM spec, (VALUES (0), (1)) t(ch)) SELECT frame, CAST(ch AS INTEGER) AS ch, k, round(CASE WHEN bits = 0 AND ch = 1 THEN 0 ELSE x END, 8) + 0.0 AS x FROM c")
def dither_removal(spark, sf):
    """Lines without bits are silent in the channel that wants no noise."""
    s = signals.spec(spark, sf).withColumn("ch", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("bits", (F.col("k") + F.col("frame")) % 5)
    return spectral.drop_dither(s, F.col("ch") == 0).select("frame", "ch", "k", F.round("x", 8).alias("x"))


# --------------------------------------------------------------------------- floors, submaps and reuse
_XS = "xs AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(round_even(abs(CAST(v AS DOUBLE)) * 1000, 0) AS INTEGER)) AS x FROM embeddings)"


def _points(spark, sf):
    return signals.table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.rint(F.abs(v.cast("double")) * 1000).cast("int")).alias("x"))


@query(f"WITH {_XS}, u AS (SELECT vec_id, x, unnest(range(64)) AS i FROM xs), o AS (SELECT vec_id, string_agg(CAST(i AS VARCHAR), ' ' ORDER BY x[i + 1], i) AS sorted FROM u GROUP BY 1) SELECT vec_id, sorted, len(list_distinct(x)) = 64 AS fine FROM o JOIN xs USING (vec_id)")
def floor_order(spark, sf):
    """Rising order of each list of points, and whether no two are the same."""
    return _points(spark, sf).select("vec_id", F.array_join(floors.argsort("x").cast("array<string>"), " ").alias("sorted"), floors.is_distinct("x").alias("fine"))


@query(f"""WITH {_XS}, u AS (SELECT vec_id, unnest(range(12)) AS i, x FROM xs), p AS (SELECT vec_id, i, x[i + 1] AS v FROM u)
SELECT a.vec_id, CAST(a.i AS INTEGER) AS i, CAST(arg_max(b.i, struct_pack(v := b.v, i := -b.i)) FILTER (b.v < a.v) AS INTEGER) AS low, CAST(arg_min(b.i, struct_pack(v := b.v, i := b.i)) FILTER (b.v > a.v) AS INTEGER) AS high FROM p a JOIN p b ON b.vec_id = a.vec_id AND b.i < a.i WHERE a.i >= 2 GROUP BY 1, 2""")
def floor_neighbours(spark, sf):
    """Nearest points placed before each of the first twelve."""
    p = _points(spark, sf).select("vec_id", floors.neighbours(F.slice("x", F.lit(1), F.lit(12))).alias("n"))
    return p.select("vec_id", F.posexplode("n").alias("i", "p")).select("vec_id", (F.col("i") + 2).alias("i"), F.col("p.low").cast("int").alias("low"), F.col("p.high").cast("int").alias("high"))


@query("SELECT CAST(l_orderkey AS BIGINT) AS mapping, CAST(l_linenumber % 3 AS INTEGER) AS submap, string_agg(CAST(l_partkey AS VARCHAR), ' ' ORDER BY l_partkey) AS channels FROM lineitem GROUP BY 1, 2")
def submap_channels(spark, sf):
    m = signals.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("mapping"), F.col("l_partkey").alias("ch"), (F.col("l_linenumber") % 3).cast("int").alias("submap"))
    return floors.submap_channels(m).withColumn("channels", F.array_join(F.col("channels").cast("array<string>"), " "))


@query("WITH c AS (SELECT vec_id AS frame, CAST(ch AS INTEGER) AS ch, embedding[ch + 1] > 0 AS used FROM embeddings, range(5) t(ch)) SELECT frame, a.ch, a.used OR coalesce(b.used, false) AS used FROM c a LEFT JOIN (SELECT frame, [1, 0, 3, 2][ch + 1] AS ch, used FROM c WHERE ch < 4) b USING (frame, ch)")
def coupled_use(spark, sf):
    """Five channels of which two pairs are coupled."""
    c = signals.table(spark, sf, "embeddings").select(F.col("vec_id").alias("frame"), F.posexplode(F.slice("embedding", F.lit(1), F.lit(5))).alias("ch", "v")).select("frame", "ch", (F.col("v") > 0).alias("used"))
    return floors.used_channels(c, spark.createDataFrame([(0, 1), (2, 3)], "a int, b int"))


_MIN = [250, 3, 6, 3, 3, 3, 4, 3, 3, 3, 461]


def _apart_sql() -> str:
    up = [f"greatest(x[1], {_MIN[0]})"]
    steps = [f"s AS (SELECT vec_id, list_sort(list_transform(embedding[1:10], lambda v: CAST(round_even(abs(CAST(v AS DOUBLE)) * 30000, 0) AS BIGINT))) AS x FROM embeddings)", f"u0 AS (SELECT *, {up[0]} AS a0 FROM s)"]
    steps += [f"u{i} AS (SELECT *, greatest(x[{i + 1}], least(a{i - 1} + {_MIN[i]}, 32767)) AS a{i} FROM u{i - 1})" for i in range(1, 10)]
    steps += [f"d9 AS (SELECT *, least(a9, 32768 - {_MIN[10]}) AS b9 FROM u9)"]
    steps += [f"d{i} AS (SELECT *, least(a{i}, b{i + 1} - {_MIN[i + 1]}) AS b{i} FROM d{i + 1})" for i in range(8, -1, -1)]
    return f"WITH {', '.join(steps)} SELECT vec_id, concat_ws(' ', {', '.join(f'b{i}' for i in range(10))}) AS spaced FROM d0"


@query(_apart_sql())
def line_spectrum_spacing(spark, sf):
    x = signals.table(spark, sf, "embeddings").select("vec_id", F.transform(F.slice("embedding", F.lit(1), F.lit(10)), lambda v: F.rint(F.abs(v.cast("double")) * 30000).cast("long")).alias("x"))
    return x.select("vec_id", F.array_join(floors.space_apart("x", _MIN).cast("array<string>"), " ").alias("spaced"))


@query(f"WITH {SIG}, r AS (SELECT stream_id, n, CASE WHEN abs(s) % 7 = 0 THEN s END AS v FROM sig) SELECT stream_id, n, last_value(v IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY n) AS v FROM r")
def reused_values(spark, sf):
    """Values that hold until the next one."""
    s = signals.sig(spark, sf).select("stream_id", "n", F.when(F.abs("s") % 7 == 0, F.col("s")).alias("v"))
    return packets.last_known(s, ["stream_id"], "n", "v", block=1 << 10)


# --------------------------------------------------------------------------- allocation and code tables
_PSD = "psd AS (SELECT vec_id, list_transform(embedding[1:50], lambda v: CAST(3072 - ((CAST(round_even(abs(CAST(v AS DOUBLE)) * 60, 0) AS INTEGER) % 25) << 7) AS INTEGER)) AS p FROM embeddings)"
_LOW = "CASE WHEN p[b + 1] + 256 = coalesce(p[b + 2], 0) THEN {1} WHEN p[b + 1] > coalesce(p[b + 2], 0) THEN greatest({0} - 64, 0) ELSE {0} END"


def _low(b: str) -> str:
    x = _LOW.replace("p[b + 1]", f"p[{b} + 1]").replace("p[b + 2]", f"p[{b} + 2]")
    return f"(CASE WHEN {b} < 7 THEN {x.format('low', 384)} WHEN {b} < 20 THEN {x.format('low', 320)} WHEN {b} < 22 THEN greatest(low - 128, 0) ELSE low END)"


_HEAR = "[" + ", ".join(str(h[0]) for h in allocation.HEARING) + "]"
_MASK_SQL = f"""WITH RECURSIVE {_PSD}, f(vec_id, p, b, low, fast, slow, begun, e) AS (
SELECT vec_id, p, CAST(-1 AS BIGINT), 0, 0, 0, false, 0 FROM psd
UNION ALL SELECT vec_id, p, b1, low1, fast1, slow1, begun1, CASE WHEN rise THEN fast1 - low1 WHEN b1 < 22 THEN greatest(fast1 - low1, slow1) ELSE greatest(fast1, slow1) END FROM (
SELECT vec_id, p, b + 1 AS b1, {_low('(b + 1)')} AS low1, (b + 1 < 7 AND NOT begun) AS rise,
CASE WHEN b + 1 < 7 AND NOT begun THEN p[b + 2] - 512 ELSE greatest(fast - 63, p[b + 2] - 512) END AS fast1, CASE WHEN b + 1 < 7 AND NOT begun THEN p[b + 2] - 1240 ELSE greatest(slow - 17, p[b + 2] - 1240) END AS slow1,
begun OR (b + 1 >= 2 AND p[b + 2] <= coalesce(p[b + 3], 0)) OR b + 1 >= 6 AS begun1 FROM f WHERE b < 49)),
m AS (SELECT vec_id, b, p[b + 1] AS psd, greatest({_HEAR}[b + 1], e + (greatest(2304 - p[b + 1], 0) >> 2)) AS mask FROM f WHERE b >= 0)
SELECT vec_id, CAST(b AS INTEGER) AS band, CAST(psd AS INTEGER) AS psd, CAST(mask AS INTEGER) AS mask, CAST([{', '.join(map(str, allocation.POINTERS))}][greatest(0, least(63, (psd - ((greatest(mask - 200 - 368, 0) & 8160) + 368)) >> 5)) + 1] AS INTEGER) AS pointer FROM m"""


@query(_MASK_SQL)
def bit_allocation(spark, sf):
    """Masks of 50 bands and the resolution of a line in each."""
    p = signals.table(spark, sf, "embeddings").select("vec_id", F.transform(F.slice("embedding", F.lit(1), F.lit(50)), lambda v: (3072 - (F.rint(F.abs(v.cast("double")) * 60).cast("int") % 25) * 128).cast("int")).alias("psd"))
    m = allocation.masking_curve(p, 512, 1240, 63, 17, 2304)
    rows = m.select("vec_id", F.posexplode(F.arrays_zip("psd", "mask")).alias("band", "x")).select("vec_id", "band", "x.psd", "x.mask")
    return allocation.allocation(rows, 200, 368)


_X = [0, 128, 64, 32, 96, 16, 48, 112]


def _floor_sql() -> str:
    steps = ["y AS (SELECT vec_id, list_transform(embedding[1:8], lambda v: CAST(round_even(abs(CAST(v AS DOUBLE)) * 100, 0) AS BIGINT) % 64) AS y FROM embeddings)", "s1 AS (SELECT *, y[1] AS l0, y[2] AS l1 FROM y)"]
    bends = [[], []]
    for i in range(2, 8):
        low = max((k for k in range(i) if _X[k] < _X[i]), key=lambda k: _X[k])
        high = min((k for k in range(i) if _X[k] > _X[i]), key=lambda k: _X[k])
        p = f"(l{low} + CAST(trunc((l{high} - l{low}) * {_X[i] - _X[low]} / CAST({_X[high] - _X[low]} AS DOUBLE)) AS BIGINT))"
        steps.append(f"p{i} AS (SELECT *, {p} AS p FROM s{i - 1})")
        far = f"CASE WHEN 128 - p > p THEN y[{i + 1}] ELSE 127 - y[{i + 1}] END"
        near = f"CASE WHEN y[{i + 1}] % 2 = 1 THEN p - (y[{i + 1}] + 1) // 2 ELSE p + y[{i + 1}] // 2 END"
        steps.append(f"s{i} AS (SELECT * EXCLUDE (p), CASE WHEN y[{i + 1}] = 0 THEN p WHEN y[{i + 1}] >= 2 * least(128 - p, p) THEN {far} ELSE {near} END AS l{i} FROM p{i})")
        bends.append([i])
        bends[low].append(i)
        bends[high].append(i)
    used = [f"(CASE WHEN {'true' if k < 2 else ' OR '.join(f'y[{i + 1}] <> 0' for i in b)} THEN 1 ELSE 0 END)" for k, b in enumerate(bends)]
    return f"WITH {', '.join(steps)} SELECT vec_id, concat_ws(' ', {', '.join(f'greatest(0, least(127, l{i}))' for i in range(8))}) AS level, concat_ws(' ', {', '.join(used)}) AS used FROM s7"


@query(_floor_sql())
def floor_levels(spark, sf):
    """Eight points of a floor, from differences to the line through their neighbours."""
    y = signals.table(spark, sf, "embeddings").select("vec_id", F.transform(F.slice("embedding", F.lit(1), F.lit(8)), lambda v: F.rint(F.abs(v.cast("double")) * 100).cast("long") % 64).alias("y"))
    f = allocation.floor_points(y, _X, 128)
    text = lambda c, t: F.array_join(F.col(c).cast(f"array<{t}>").cast("array<string>"), " ")
    return f.select("vec_id", text("level", "int").alias("level"), text("used", "int").alias("used"))


@query(f"""WITH t AS (SELECT event_id, 2 + event_id % 30 AS n, event_id % 400 AS b, (event_id * 7) % 40 - 20 AS o, event_id % 16 AS cap, event_id % 2 = 0 AS st FROM events),
p AS (SELECT *, 2 * n - 1 - CASE WHEN st AND n = 2 THEN 1 ELSE 0 END AS n2 FROM t), q AS (SELECT *, least(64, least(b - cap - 32, CAST(trunc((b + n2 * o) / CAST(n2 AS DOUBLE)) AS BIGINT))) AS q FROM p)
SELECT event_id, CAST(CASE WHEN q < 4 THEN 1 ELSE ((({str(allocation.EIGHTHS)}[(q & 7) + 1] >> (14 - (q >> 3))) + 1) >> 1) * 2 END AS INTEGER) AS steps FROM q""")
def angle_steps(spark, sf):
    e = F.col("event_id")
    return signals.table(spark, sf, "events").select("event_id", allocation.angle_steps(2 + e % 30, e % 400, (e * 7) % 40 - 20, e % 16, e % 2 == 0).alias("steps"))


_BOOKS = "l AS (SELECT p_partkey % 50 AS book, p_partkey AS symbol, CAST(3 + p_size % 14 AS INTEGER) AS length FROM part)"


@query(f"""WITH {_BOOKS}, c AS (SELECT *, coalesce(sum(CAST(1 AS BIGINT) << (32 - length)) OVER (PARTITION BY book ORDER BY length, symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM l)
SELECT book, symbol, length, CAST(CAST(ahead AS BIGINT) >> (32 - length) AS BIGINT) AS code, CAST((CAST(ahead AS BIGINT) >> (32 - length)) + (1 << length) AS BIGINT) AS key FROM c""")
def code_tables(spark, sf):
    l = signals.table(spark, sf, "part").select((F.col("p_partkey") % 50).alias("book"), F.col("p_partkey").alias("symbol"), (3 + F.col("p_size") % 14).cast("int").alias("length"))
    return allocation.canonical_codes(l)


@query(f"""WITH RECURSIVE g(n, x) AS (SELECT 0, CAST(522133279 AS UBIGINT) UNION ALL SELECT n + 1, (x * 1664525 + 1013904223) % 4294967296 FROM g WHERE n < 2000), {SPEC},
d AS (SELECT frame, CAST(k // 8 AS INTEGER) AS band, k, CASE WHEN g.x >= 2147483648 THEN CAST(g.x AS DOUBLE) - 4294967296 ELSE CAST(g.x AS DOUBLE) END AS v FROM spec JOIN g ON g.n = (frame * 64 + k) % 2000)
SELECT frame, band, k, round(v * 0.5 / sqrt(sum(v * v) OVER (PARTITION BY frame, band)), 8) + 0.0 AS x FROM d""")
def noise_bands(spark, sf):
    """Every band as noise of a quarter's energy."""
    s = signals.spec(spark, sf).select("frame", F.floor(F.col("k") / 8).cast("int").alias("band"), "k", ((F.col("frame") * 64 + F.col("k")) % 2000).alias("draw"))
    return allocation.fill_noise(s, 522133279, 0.5).select("frame", "band", "k", F.round("x", 8).alias("x"))


# --------------------------------------------------------------------------- playback
_RESAMPLED = _resample_sql(8000, 16000)


@query(_RESAMPLED.replace(f"WITH {SIG}", f"WITH {STEREO}, sig0 AS (SELECT stream_id, n, {_clamp('sum(s) / count(*)')} AS s FROM stereo GROUP BY 1, 2), cut AS (SELECT stream_id, n - 10 AS n, s FROM sig0 WHERE n >= 10)").replace("FROM sig ", "FROM cut ").replace("JOIN sig x", "JOIN cut x").replace(" SELECT stream_id, j AS n,", ", res AS (SELECT stream_id, j AS n,", 1) + f") SELECT stream_id, n // 160 AS frame_no, CAST(count(*) AS INTEGER) AS len, string_agg(CAST({_clamp('CAST(0.5 AS DOUBLE) * s')} AS VARCHAR), ' ' ORDER BY n) AS samples FROM res WHERE n < 1600 GROUP BY 1, 2")
def player_frames(spark, sf):
    """Stereo from sample 10 on, mixed down, at double the rate and half the level, ten frames at most."""
    p = framing.play(signals.stereo(spark, sf), 8000, 16000, 160, 0.5, start=10, limit=10)
    return p.withColumn("samples", F.array_join(F.col("samples").cast("array<string>"), " "))


@query(f"WITH {SIG}, f AS (SELECT stream_id, n // 160 AS f, count(*) AS len, string_agg(CAST(s AS VARCHAR), ' ' ORDER BY n) AS samples FROM sig GROUP BY 1, 2), t AS (SELECT stream_id, max(f) + 1 AS turn FROM f GROUP BY 1) SELECT stream_id, CAST(f + k * turn AS BIGINT) AS frame_no, CAST(len AS INTEGER) AS len, samples FROM f JOIN t USING (stream_id), range(2) r(k)")
def buffer_loop(spark, sf):
    return framing.looped(signals.sig(spark, sf), 2).withColumn("samples", F.array_join(F.col("samples").cast("array<string>"), " "))


@query(f"""WITH {SIG}, w AS (SELECT stream_id, n // 8 AS f, sqrt(sum(CAST(s AS BIGINT) * s) / 8) AS r FROM sig GROUP BY 1, 2 HAVING count(*) = 8),
q AS (SELECT stream_id, (n - 40) // 8 AS f, sqrt(sum(CAST(s AS BIGINT) * s) / 8) AS r FROM sig WHERE n >= 40 GROUP BY 1, 2 HAVING count(*) = 8), p AS (SELECT * FROM q WHERE f < 12),
e AS (SELECT p.stream_id, w.f - p.f AS off, sum(pow(p.r - w.r, 2)) AS e, count(*) AS c FROM p JOIN w ON w.stream_id = p.stream_id AND w.f >= p.f GROUP BY 1, 2)
SELECT stream_id, CAST(arg_min(off, e) * 8 AS BIGINT) AS "offset" FROM e WHERE c = (SELECT count(*) FROM p WHERE p.stream_id = e.stream_id) GROUP BY 1""")
def envelope_offset(spark, sf):
    """Where each stream without its first 40 samples begins in the whole one."""
    s = signals.sig(spark, sf)
    return framing.align_envelopes(framing.trim(s, 40), s, 8)


@query(f"WITH {PAIRS} SELECT stream_id, CAST(n * 3 + c AS BIGINT) AS n, CAST([a, b, 0][c + 1] AS DOUBLE) AS x FROM pairs, range(3) t(c)")
def interleave_channels(spark, sf):
    """Two channels in a layout of three; the one that is missing is silent."""
    s = signals.stereo(spark, sf).select("stream_id", "n", "ch", F.col("s").cast("double").alias("x"))
    whole = s.groupBy("stream_id", "n").agg(F.count("*").alias("c")).filter("c = 2").drop("c")
    return framing.interleave(s.join(whole, ["stream_id", "n"]), 3)


# --------------------------------------------------------------------------- fixed point
_AB = "t AS (SELECT event_id, (event_id * 7919) % 2000003 - 1000000 AS a, (event_id * 104729) % 4000037 + 1 AS b, event_id % 5 AS n FROM events)"
_W16 = "(CASE WHEN ({0}) & 65535 >= 32768 THEN (({0}) & 65535) - 65536 ELSE ({0}) & 65535 END)"
_SAT = "greatest(-2147483648, least(2147483647, {0}))"


def _fixed_rows(spark, sf):
    e = F.col("event_id")
    return signals.table(spark, sf, "events").select("event_id", ((e * 7919) % 2000003 - 1000000).alias("a"), ((e * 104729) % 4000037 + 1).alias("b"), (e % 5).cast("int").alias("n"))


@query(f"WITH {_AB} SELECT event_id, a + ((a * b) >> 16) AS smlaww, a + {_W16.format('a')} * {_W16.format('b')} AS smlabb, {_SAT.format('a * 3000 + b')} AS add_sat, {_SAT.format('a * 3000 - b')} AS sub_sat, greatest(-2147483648 >> (n + 9), least(2147483647 >> (n + 9), a)) * (1 << (n + 9)) AS shifted, greatest(-32768, least(32767, a)) AS sat16 FROM t")
def saturating_arithmetic(spark, sf):
    r = _fixed_rows(spark, sf)
    return r.select("event_id", fixed.smlaww("a", "a", "b").alias("smlaww"), fixed.smlabb("a", "a", "b").alias("smlabb"), fixed.add_sat32(F.col("a") * 3000, "b").alias("add_sat"), fixed.sub_sat32(F.col("a") * 3000, "b").alias("sub_sat"), fixed.lshift_sat32("a", F.col("n") + 9).alias("shifted"), fixed.saturate16("a").alias("sat16"))


_INV = f"""{_AB}, h AS (SELECT *, 31 - CAST(length(bin(b)) AS INTEGER) AS hb, CASE WHEN a = 0 THEN 31 ELSE 31 - CAST(length(bin(abs(a))) AS INTEGER) END AS ha FROM t),
g AS (SELECT *, b * (1 << hb) AS nb, a * (1 << ha) AS na, 536870911 // ((b * (1 << hb)) >> 16) AS i FROM h),
e AS (SELECT *, ((536870912 - ((nb * {_W16.format('i')}) >> 16)) * 8) AS err, (na * {_W16.format('i')}) >> 16 AS q0 FROM g),
f AS (SELECT *, i * 65536 + ((err * i) >> 16) AS inv, na - (CASE WHEN (((nb * q0) >> 32) * 8) & 4294967295 >= 2147483648 THEN ((((nb * q0) >> 32) * 8) & 4294967295) - 4294967296 ELSE (((nb * q0) >> 32) * 8) & 4294967295 END) AS rest0 FROM e),
r AS (SELECT *, CASE WHEN rest0 & 4294967295 >= 2147483648 THEN (rest0 & 4294967295) - 4294967296 ELSE rest0 & 4294967295 END AS rest FROM f),
z AS (SELECT *, q0 + ((rest * {_W16.format('i')}) >> 16) AS quo, 29 + ha - hb - 16 AS sh FROM r)"""


@query(f"WITH {_INV} SELECT event_id, inv >> (61 - hb - 24) AS inverse, CASE WHEN sh < 0 THEN greatest(-2147483648 >> -sh, least(2147483647 >> -sh, quo)) * (1 << greatest(0, -sh)) WHEN sh < 32 THEN quo >> sh ELSE 0 END AS quotient FROM z")
def reciprocal_division(spark, sf):
    """2**24 / b and a * 2**16 / b by a first guess and one correction."""
    r = _fixed_rows(spark, sf)
    return r.select("event_id", fixed.inverse32("b", 24).alias("inverse"), fixed.divide32("a", "b", 16).alias("quotient"))


@query(f"""WITH x AS (SELECT event_id, event_id % 4100 - 50 AS x FROM events), p AS (SELECT *, CAST(1 AS BIGINT) << greatest(0, x >> 7) AS o, x & 127 AS f FROM x), i AS (SELECT *, f + ((f * (128 - f) * -174) >> 16) AS c FROM p)
SELECT event_id, CAST(CASE WHEN x < 0 THEN 0 WHEN x >= 3967 THEN 2147483647 WHEN x < 2048 THEN o + ((o * c) >> 7) ELSE o + (o >> 7) * c END AS BIGINT) AS y, CAST(trunc((2 * (event_id % 15) - 14) * 8388608 / 15.0) AS BIGINT) AS m FROM i""")
def log_to_linear(spark, sf):
    """Powers of two by a parabola, and mantissas of a quantiser of 15 levels."""
    e = signals.table(spark, sf, "events").select("event_id", (F.col("event_id") % 4100 - 50).alias("x"))
    return e.select("event_id", fixed.log2lin("x").alias("y"), fixed.symmetric_dequant(F.col("event_id") % 15, 15).alias("m"))


@query(f"WITH {WORD} SELECT doc_id, CAST(32 - length(bin(w)) AS INTEGER) AS zeros FROM w WHERE w > 0")
def unary_codes(spark, sf):
    return raw(spark, sf).filter(F.octet_length("b") >= 4).select("doc_id", bits.unary(word32(), 32).alias("zeros")).filter("zeros < 32")


# --------------------------------------------------------------------------- streams
def _streamed(spark, sf, run):
    """The signals in pieces of 160 samples through a streaming query, written as a table of its own and read again."""
    import uuid

    from sonaril.session import shared_folder
    from sonaril.streaming import stateful

    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex[:12]}"
    frames = framing.tumbling(signals.sig(spark, sf))
    last = frames.groupBy("stream_id").agg(F.max("frame_no").alias("last"))
    pieces = frames.join(last, "stream_id").select("stream_id", F.col("frame_no").alias("seq"), F.col("samples").cast("array<smallint>").alias("samples"), (F.col("frame_no") == F.col("last")).alias("eos"))
    pieces.write.parquet(f"{base}/in")
    return _run_stream(spark, run(spark.readStream.schema(stateful.PIECES).parquet(f"{base}/in")), base)


def _run_stream(spark, out, base):
    """What a streaming DataFrame gives from all that is there, by way of a table in ``base``."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(provider)
        else:
            spark.conf.set(provider, before)
    return spark.read.schema(out.schema).parquet(f"{base}/out")


@query(_resample_sql(8000, 16000))
def stream_resample(spark, sf):
    from sonaril.streaming import stateful

    return _streamed(spark, sf, lambda pieces: stateful.resample_stream(pieces, 8000, 16000))


@query(f"WITH {SIG} SELECT stream_id, n // 100 AS frame_no, string_agg(CAST(s AS VARCHAR), ' ' ORDER BY n) AS samples FROM sig GROUP BY 1, 2")
def stream_frames(spark, sf):
    from sonaril.streaming import stateful

    f = _streamed(spark, sf, lambda pieces: stateful.frame_stream(pieces, 100))
    return f.withColumn("samples", F.array_join(F.col("samples").cast("array<string>"), " "))


@query(filters.SQL_48K)
def stream_voice(spark, sf):
    """Voice of 8 kHz at 48 kHz, piece by piece."""
    from sonaril.streaming import stateful

    return _streamed(spark, sf, lambda pieces: stateful.raise_stream(pieces, 8000))
