"""Predictors and difference chains."""

from __future__ import annotations

from math import comb

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonaril.operators.ordering import BLOCK, with_halo
from sonaril.operators.recurrence import BLOCK as RUN
from sonaril.operators.recurrence import linear_recurrence


def fixed_residual(df: DataFrame, order: int, block: int = BLOCK) -> DataFrame:
    """(stream_id, n, s) with running numbers n -> residual of the fixed predictor; the first ``order`` rows keep their samples.

    Windows stay inside blocks, each with the ``order`` samples before it.
    """
    w = Window.partitionBy("stream_id", "_block").orderBy("n")
    r = F.col("s").cast("long")
    for k in range(1, order + 1):
        r = r + (-1) ** k * comb(order, k) * F.lag("s", k).over(w).cast("long")
    out = with_halo(df.select("stream_id", "n", "s"), "n", order, block).withColumn("r", F.when(F.col("n") < order, F.col("s").cast("long")).otherwise(r))
    return out.filter(~F.col("_halo")).select("stream_id", "n", "r")


def fixed_predict(df: DataFrame, order: int, block: int = RUN) -> DataFrame:
    """(stream_id, n, r) -> (stream_id, n, s): inverts the predictor as one linear recurrence; the first ``order`` rows are samples."""
    if not order:
        return df.select("stream_id", "n", F.col("r").cast("long").alias("s"))
    return linear_recurrence(df, [-((-1) ** k) * comb(order, k) for k in range(1, order + 1)], "r", "s", warm=order, block=block)


def delta_chain(df: DataFrame, start: int, bias: int = 60) -> DataFrame:
    """(frame, band, d) -> (frame, band, v): v = start + sum of (d - bias) over the bands so far."""
    w = Window.partitionBy("frame").orderBy("band").rowsBetween(Window.unboundedPreceding, 0)
    return df.select("frame", "band", (F.lit(start) + F.sum(F.col("d") - bias).over(w)).cast("long").alias("v"))


def clamped_chain(df: DataFrame, lo: int, hi: int) -> DataFrame:
    """(frame, steps array<int>) -> values with every step clamped, as an ordered fold (a window can't clamp)."""
    fold = F.aggregate(
        "steps",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda acc, d: F.struct(
            F.greatest(F.lit(lo), F.least(F.lit(hi), acc["at"] + d)).cast("int").alias("at"),
            F.concat(acc["out"], F.array(F.greatest(F.lit(lo), F.least(F.lit(hi), acc["at"] + d)).cast("int"))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return df.withColumn("values", fold)
