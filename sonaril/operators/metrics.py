"""Comparison and coverage aggregates."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compare(pairs: DataFrame) -> DataFrame:
    """(stream_id, a, b) -> correlation, RMS difference and relative RMS, in one pass."""
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    return pairs.groupBy("stream_id").agg(F.corr(a, b).alias("corr"), F.sqrt(F.avg((a - b) * (a - b))).alias("rms"), F.sqrt(F.sum((a - b) * (a - b)) / F.sum(a * a)).alias("relative"))


def best_lag(a: DataFrame, b: DataFrame, most: int, block: int = 1 << 12) -> DataFrame:
    """(stream_id, lag, r): the lag from -most to most with the highest uncentred correlation, the smaller one on ties.

    Streams have running numbers. Samples meet as arrays, one row per block of ``a`` with ``most`` more samples of ``b`` on either side; a block
    gives three sums per lag.
    """
    at = lambda shift: F.floor((F.col("n") + shift) / block)
    own = a.select("stream_id", at(0).alias("_block"), F.lit(0).alias("side"), "n", F.col("s").cast("long").alias("s"))
    near = b.select("stream_id", F.explode(F.array_distinct(F.array(at(-most), at(0), at(most)))).alias("_block"), F.lit(1).alias("side"), "n", F.col("s").cast("long").alias("s"))
    side = lambda k: F.array_sort(F.collect_list(F.when(F.col("side") == k, F.struct("n", "s"))))
    met = own.unionByName(near).groupBy("stream_id", "_block").agg(side(0).alias("a"), side(1).alias("b")).filter("size(a) > 0 AND size(b) > 0")
    met = met.withColumn("from", F.get("b", F.lit(0))["n"])
    start = F.struct(*(F.lit(0).cast("long").alias(c) for c in ("ab", "aa", "bb")))

    def add(t, x, lag):
        y = F.get("b", (x["n"] + lag - F.col("from")).cast("int"))["s"]
        more = lambda u, v: F.coalesce(u * v, F.lit(0).cast("long"))
        return F.struct((t["ab"] + more(x["s"], y)).alias("ab"), (t["aa"] + F.when(y.isNotNull(), x["s"] * x["s"]).otherwise(0)).alias("aa"), (t["bb"] + more(y, y)).alias("bb"))

    # all lags inside the row: only three sums a lag leave it
    lags = F.transform(F.sequence(F.lit(-most), F.lit(most)), lambda lag: F.struct(lag.alias("lag"), F.aggregate("a", start, lambda t, x: add(t, x, lag)).alias("t")))
    parts = met.select("stream_id", F.explode(lags).alias("p")).select("stream_id", "p.lag", "p.t")
    sums = parts.groupBy("stream_id", "lag").agg(*(F.sum(f"t.{c}").alias(c) for c in ("ab", "aa", "bb")))
    r = sums.filter("aa > 0 AND bb > 0").withColumn("r", F.col("ab") / (F.sqrt(F.col("aa").cast("double")) * F.sqrt(F.col("bb").cast("double"))))
    top = r.groupBy("stream_id").agg(F.max(F.struct("r", (-F.col("lag")).alias("neg"))).alias("m"))
    return top.select("stream_id", (-F.col("m.neg")).alias("lag"), F.col("m.r").alias("r"))


def tone_level(df: DataFrame, hz: float, rate: int) -> DataFrame:
    """(stream_id, level): amplitude of one frequency, as a Fourier bin."""
    w = 2 * math.pi * hz / rate
    g = df.groupBy("stream_id").agg(F.sum(F.col("s") * F.cos(F.col("n") * w)).alias("c"), F.sum(F.col("s") * F.sin(F.col("n") * w)).alias("d"), F.count("*").alias("len"))
    return g.select("stream_id", (2 * F.sqrt(F.col("c") * F.col("c") + F.col("d") * F.col("d")) / F.col("len")).alias("level"))


def coverage(df: DataFrame, by: list[str], paths: dict) -> DataFrame:
    """How often each path's condition holds, per group."""
    return df.groupBy(*by).agg(*[F.count_if(c).alias(k) for k, c in paths.items()])
