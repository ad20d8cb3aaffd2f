"""Queries on pulse vectors, their rotation and bit searches, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from sonaril.operators import floors, pulses, signals, spectrum_lines
from sonaril.plans.catalog import SPEC, query

_N, _K = 5, 4


@query(f"""WITH v AS (SELECT [a, b, c, d, e] AS y FROM range(-4, 5) t1(a), range(-4, 5) t2(b), range(-4, 5) t3(c), range(-4, 5) t4(d), range(-4, 5) t5(e) WHERE abs(a) + abs(b) + abs(c) + abs(d) + abs(e) = 4),
o AS (SELECT y, row_number() OVER (ORDER BY list_transform(y, lambda q: CASE WHEN q >= 0 THEN 4 - q ELSE 9 + q END)) - 1 AS i FROM v)
SELECT event_id, CAST(unnest(range(5)) AS INTEGER) AS j, CAST(unnest(y) AS INTEGER) AS y FROM events JOIN o ON o.i = (event_id * 7919) % (SELECT count(*) FROM v)""")
def pulse_vectors(spark, sf):
    """Vectors of five numbers and four pulses from their indices."""
    e = signals.table(spark, sf, "events").select("event_id", F.lit(_N).alias("n"), F.lit(_K).alias("k"), ((F.col("event_id") * 7919) % pulses.vectors(_N, _K)).cast("long").alias("index"))
    return pulses.pulse_vectors(e).select("event_id", F.posexplode("y").alias("j", "y"))


def _chain(name: str, source: str, step: int, c: str, s: str) -> str:
    """CTEs of one sweep over 64 lines ``step`` apart: chains of a residue, up with a carried value, then down."""
    last = 64 // step - 1
    return f"""{name}x AS (SELECT frame, k % {step} AS r, k // {step} AS j, x FROM {source}),
{name}u(frame, r, j, t, x) AS (SELECT frame, r, j, x, CAST(NULL AS DOUBLE) FROM {name}x WHERE j = 0 UNION ALL SELECT a.frame, a.r, a.j, {c} * a.x + {s} * u.t, {c} * u.t - {s} * a.x FROM {name}u u JOIN {name}x a ON a.frame = u.frame AND a.r = u.r AND a.j = u.j + 1),
{name}z AS (SELECT frame, r, j - 1 AS j, x FROM {name}u WHERE j > 0 UNION ALL SELECT frame, r, j, t FROM {name}u WHERE j = {last}),
{name}d(frame, r, j, t, x) AS (SELECT frame, r, j, x, CAST(NULL AS DOUBLE) FROM {name}z WHERE j = {last - 1} UNION ALL SELECT a.frame, a.r, a.j, {c} * a.x - {s} * d.t, {c} * d.t + {s} * a.x FROM {name}d d JOIN {name}z a ON a.frame = d.frame AND a.r = d.r AND a.j = d.j - 1),
{name} AS (SELECT frame, r + {step} * j AS k, x FROM {name}z WHERE j = {last} UNION ALL SELECT frame, r + {step} * (j + 1), x FROM {name}d WHERE j < {last - 1} UNION ALL SELECT frame, r, t FROM {name}d WHERE j = 0)"""


_THETA = "pow(64 / CAST(64 + 10 * 4 AS DOUBLE), 2) / 2"


@query(f"""WITH RECURSIVE {SPEC}, {_chain('a', 'spec', 8, f'sin(pi() / 2 * {_THETA})', f'cos(pi() / 2 * {_THETA})')}, {_chain('b', 'a', 1, f'cos(pi() / 2 * {_THETA})', f'sin(pi() / 2 * {_THETA})')} SELECT frame, CAST(k AS INTEGER) AS k, round(x, 7) + 0.0 AS x FROM b""")
def pulse_rotation(spark, sf):
    """Shapes of 64 lines and four pulses, spread at the middle width."""
    e = signals.table(spark, sf, "embeddings").select(F.col("vec_id").alias("frame"), F.col("embedding").cast("array<double>").alias("x"), F.lit(1).alias("blocks"), F.lit(4).alias("k"), F.lit(2).alias("spread"))
    return pulses.spread_rotation(e).select("frame", F.posexplode("x").alias("k", "x")).withColumn("x", F.round("x", 7))


@query("""WITH c AS (SELECT k, CASE WHEN k = 0 THEN 0 ELSE CAST(ceil(8 * log2([0, 16, 128, 688, 2816, 9424, 27008, 68464, 157184][k + 1]) - 0.000000001) AS INTEGER) END AS cost FROM range(9) t(k)),
e AS (SELECT event_id, CAST((event_id * 31) % 150 AS INTEGER) AS bits FROM events)
SELECT event_id, bits, CAST(arg_min(k, abs(cost - bits) * 100 + k) AS INTEGER) AS pulses FROM e, c GROUP BY 1, 2""")
def pulses_for_bits(spark, sf):
    """How many pulses a vector of eight numbers gets for some eighths of bits."""
    costs = F.array(*[F.lit(v) for v in pulses.pulse_costs(8, 8)])
    e = signals.table(spark, sf, "events").select("event_id", ((F.col("event_id") * 31) % 150).cast("int").alias("bits"))
    return e.withColumn("pulses", pulses.pulses_for(costs, F.col("bits")))


# A frame of eight bands, and eleven rising rows of bits a line.
EDGES = [0, 1, 2, 4, 6, 8, 12, 16, 24]
ROWS = [[q * (12 + 2 * (7 - j)) for j in range(8)] for q in range(11)]


@query("""WITH b AS (SELECT j, [1, 1, 2, 2, 2, 4, 4, 8][j + 1] AS w, CAST(250 + 10 * j AS BIGINT) AS cap FROM range(8) t(j)), t AS (SELECT *, greatest(8, 3 * w * 4 // 2) AS least FROM b),
e AS (SELECT event_id, 20 + (event_id * 37) % 1500 AS total, event_id % 11 AS trim FROM events),
r AS (SELECT e.*, t.*, q, w * q * (12 + 2 * (7 - j)) AS base, CAST(floor(w * (7 - j) * (trim - 7) / 2.0) AS BIGINT) AS tilt, CASE WHEN j = event_id % 8 THEN 16 ELSE 0 END AS extra FROM e, t, range(12) u(q)),
v AS (SELECT *, CASE WHEN q = 11 THEN cap ELSE base END AS raw FROM r), p AS (SELECT *, CASE WHEN raw > 0 THEN greatest(0, raw + tilt) ELSE 0 END AS plain FROM v),
f AS (SELECT event_id, total, q, max(CASE WHEN plain + extra >= least THEN j ELSE -1 END) AS f FROM p GROUP BY ALL),
s AS (SELECT f.event_id, f.total, f.q, sum(CASE WHEN j <= f THEN least(plain + extra, cap) WHEN plain + extra >= 8 THEN 8 ELSE 0 END) AS spent FROM f JOIN p USING (event_id, q) WHERE q < 11 GROUP BY ALL),
l AS (SELECT event_id, coalesce(max(q) FILTER (spent <= total AND q > 0), 0) AS level FROM s GROUP BY 1),
g AS (SELECT a.event_id, a.total, a.j, a.cap, a.least, l.level, CASE WHEN level > 0 THEN a.plain + a.extra ELSE a.plain END AS low, greatest(0, z.plain + z.extra - CASE WHEN level > 0 THEN a.plain + a.extra ELSE a.plain END) AS gap FROM l JOIN p a ON a.event_id = l.event_id AND a.q = l.level JOIN p z ON z.event_id = l.event_id AND z.q = l.level + 1 AND z.j = a.j),
m AS (SELECT g.*, m, low + (gap * m) // 64 AS x FROM g, range(64) t(m)), h AS (SELECT event_id, m, max(CASE WHEN x >= least THEN j ELSE -1 END) AS f FROM m GROUP BY 1, 2),
y AS (SELECT m.*, f, CASE WHEN j <= f THEN least(x, cap) WHEN x >= 8 THEN least(8, cap) ELSE 0 END AS given FROM m JOIN h USING (event_id, m)),
c AS (SELECT event_id, coalesce(max(m) FILTER (spent <= total), 0) AS step FROM (SELECT event_id, total, m, sum(given) AS spent FROM y GROUP BY ALL) GROUP BY 1)
SELECT y.event_id AS frame, CAST(level AS INTEGER) AS level, CAST(step AS INTEGER) AS step, CAST(j AS INTEGER) AS band, CAST(given AS INTEGER) AS bits FROM y JOIN c ON c.event_id = y.event_id AND c.step = y.m""")
def band_allocation(spark, sf):
    """Bits of the bands of a frame within its total."""
    at = F.col("event_id")
    extra = F.array(*[F.when(at % 8 == j, 16).otherwise(0) for j in range(8)])
    e = signals.table(spark, sf, "events").select(at.alias("frame"), (20 + (at * 37) % 1500).cast("int").alias("total"), (at % 11).cast("int").alias("trim"), F.array(*[F.lit(250 + 10 * j) for j in range(8)]).alias("caps"), extra.alias("extra"))
    return pulses.allocate(e, EDGES, ROWS, 1, 2).select("frame", "level", "step", F.posexplode("bits").alias("band", "bits"))


# --------------------------------------------------------------------------- residues
_BOOKS = [(0, 0, 0), (1, 0, 0), (1, 1, 1), (2, 0, 1), (2, 2, 2)]  # class, pass, book
_DIMS = [2, 4, 8]
_CODES = """l AS (SELECT l_orderkey AS frame, l_linenumber - 1 AS part, CAST(sum(l_partkey) AS BIGINT) AS seed, CAST(sum(l_suppkey) % 3 AS INTEGER) AS class FROM lineitem GROUP BY 1, 2),
b AS (SELECT * FROM (VALUES (0, 0, 0, 2), (1, 0, 0, 2), (1, 1, 1, 4), (2, 0, 1, 4), (2, 2, 2, 8)) t(class, pass, book, dim)),
e AS (SELECT frame, part, pass, book, dim, i, (seed + 7 * i + 13 * pass) % 16 AS entry FROM l JOIN b USING (class), range(4) t(i) WHERE i < 8 // dim),
v AS (SELECT e.*, j, ((entry * (j + 1) * (book + 2)) % 11 - 5) / CAST(4 AS DOUBLE) AS x FROM e, range(8) u(j) WHERE j < dim)"""


def _residue(layout: int, place: str):
    def run(spark, sf):
        per = signals.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("frame"), (F.col("l_linenumber") - 1).alias("part")).agg(F.sum("l_partkey").alias("seed"), (F.sum("l_suppkey") % 3).cast("int").alias("class")).withColumn("ch", F.lit(0))
        books = F.broadcast(spark.createDataFrame(_BOOKS, "class int, pass int, book int"))  # fixed tables of the set-up
        values = F.broadcast(spark.createDataFrame([(b, e, [((e * (j + 1) * (b + 2)) % 11 - 5) / 4 for j in range(d)]) for b, d in enumerate(_DIMS) for e in range(16)], "book int, entry long, v array<double>"))
        codes = per.select("frame", "ch", "part", "seed", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("pass")).select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i"))
        # a pass has as many codes as vectors of its book fill a partition
        used = codes.join(per.select("frame", "part", "class"), ["frame", "part"]).join(F.broadcast(spark.createDataFrame([(c, p, 8 // _DIMS[b]) for c, p, b in _BOOKS], "class int, pass int, codes int")), ["class", "pass"]).filter("i < codes")
        entries = used.select("frame", "ch", "part", "pass", "i", ((F.col("seed") + 7 * F.col("i") + 13 * F.col("pass")) % 16).alias("entry"))
        return floors.residue(entries, per.select("frame", "ch", "part", "class"), books, values, 8, layout, channels=2, begin=4, lines=50).select("frame", "ch", "k", F.round("x", 6).alias("x"))

    query(f"WITH {_CODES}, p AS (SELECT frame, 4 + part * 8 + {place} AS p, x FROM v), q AS (SELECT frame, {'CAST(p % 2 AS INTEGER) AS ch, p // 2' if layout == 2 else '0 AS ch, p'} AS k, x FROM p) SELECT frame, ch, CAST(k AS BIGINT) AS k, round(sum(x), 6) + 0.0 AS x FROM q WHERE k < 50 GROUP BY 1, 2, 3", f"residue_layout_{layout}")(run)


for _layout, _place in ((0, "i + j * (8 // dim)"), (1, "i * dim + j"), (2, "i * dim + j")):
    _residue(_layout, _place)


# --------------------------------------------------------------------------- line spectra
def _lsf_sql() -> str:
    """Order ten, lines far apart: cosines, two products root by root, and their sums, each step a CTE; stable filters need no more."""
    half = lambda x, n: f"((({x}) >> {n - 1}) + 1) >> 1"
    table = "[8192, 8190, 8182, 8170, 8152, 8130, 8104, 8072, 8034, 7994, 7946, 7896, 7840, 7778, 7714, 7644, 7568, 7490, 7406, 7318, 7226, 7128, 7026, 6922, 6812, 6698, 6580, 6458, 6332, 6204, 6070, 5934, 5792, 5648, 5502, 5352, 5198, 5040, 4880, 4718, 4552, 4382, 4212, 4038, 3862, 3684, 3502, 3320, 3136, 2948, 2760, 2570, 2378, 2186, 1990, 1794, 1598, 1400, 1202, 1002, 802, 602, 402, 202, 0]"
    look = lambda i: f"CASE WHEN {i} <= 64 THEN t[{i} + 1] ELSE -t[129 - ({i})] END"
    cos = lambda k: "(" + half(f"256 * ({look(f'(l[{k + 1}] >> 8)')}) + (({look(f'((l[{k + 1}] >> 8) + 1)')}) - ({look(f'(l[{k + 1}] >> 8)')})) * (l[{k + 1}] & 255)", 4) + ")"
    place = [0, 9, 6, 3, 4, 5, 8, 1, 2, 7]  # where each line goes
    steps = [f"l AS (SELECT vec_id, list_transform(range(10), lambda k: CAST((k + 1) * 32768 // 11 + CAST(round_even(CAST(embedding[k + 1] AS DOUBLE) * 1000, 0) AS BIGINT) % 700 AS BIGINT)) AS l, {table} AS t FROM embeddings)"]
    steps.append("r AS (SELECT vec_id, " + ", ".join(f"CAST({cos(k)} AS BIGINT) AS c{place[k]}" for k in range(10)) + " FROM l)")
    steps.append("s0 AS (SELECT *, 65536 AS p0, -c0 AS p1, 65536 AS q0, -c1 AS q1 FROM r)")
    for k in range(1, 5):
        new = []
        for x, o in (("p", 0), ("q", 1)):
            c = f"c{2 * k + o}"
            new += [f"65536 AS {x}0", f"{x}1 - {c} AS {x}1"]
            new += [f"{x}{n} + {x}{n - 2} - ({half(f'{c} * {x}{n - 1}', 16)}) AS {x}{n}" for n in range(2, k + 1)]
            new.append(f"2 * {x}{k - 1} - ({half(f'{c} * {x}{k}', 16)}) AS {x}{k + 1}")
        steps.append(f"s{k} AS (SELECT vec_id, {', '.join(f'c{i}' for i in range(10))}, {', '.join(new)} FROM s{k - 1})")
    a = [f"-(q{k + 1} - q{k}) - (p{k + 1} + p{k})" for k in range(5)] + [f"(q{k + 1} - q{k}) - (p{k + 1} + p{k})" for k in range(4, -1, -1)]
    return f"WITH {', '.join(steps)} SELECT vec_id, CAST(unnest(range(10)) AS INTEGER) AS i, CAST(unnest([{', '.join(half(x, 5) for x in a)}]) AS INTEGER) AS a FROM s4"


@query(_lsf_sql())
def line_filter(spark, sf):
    """Ten lines about evenly spread, to a prediction filter."""
    e = signals.table(spark, sf, "embeddings").withColumn("v", F.slice(F.col("embedding").cast("array<double>"), 1, 10))
    lines = F.transform("v", lambda x, k: (F.floor((k + 1) * 32768 / 11) + F.rint(x * 1000).cast("long") % 700).cast("int"))
    return spectrum_lines.line_filters(e.select("vec_id", lines.alias("lines"))).select("vec_id", F.posexplode("a").alias("i", "a"))
