"""Channel and source arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonaril.functions.pcm import clamp16, gain, scaled_source


def downmix(df: DataFrame) -> DataFrame:
    """(stream_id, n, ch, s) -> mono by averaging, half-even; one partial aggregate per sample."""
    return df.groupBy("stream_id", "n").agg(clamp16(F.sum("s") / F.count("s")).alias("s"))


def apply_gain(df: DataFrame, g: float) -> DataFrame:
    return df.withColumn("s", gain("s", g))


def mix(sources: DataFrame, gains: DataFrame | None = None) -> DataFrame:
    """(n, source, s[, gain]) -> (n, s): rounded after gain, summed wide, clipped once.

    ``gains`` (source, gain) are looked up; a source without one has gain 1. Sources may end anywhere.
    """
    if gains is not None:
        sources = sources.drop("gain").join(gains, "source", "left")
    g = "gain" if "gain" in sources.columns else F.lit(1.0)
    return sources.groupBy("n").agg(F.sum(scaled_source("s", g)).alias("s")).select("n", clamp16("s").alias("s"))


def pair_channels(df: DataFrame, value: str = "s", keys: tuple[str, ...] = ("stream_id", "n")) -> DataFrame:
    """Left and right beside each other in one shuffle (no self-join)."""
    side = lambda c: F.max(F.when(F.col("ch") == c, F.col(value)))
    return df.groupBy(*keys).agg(side(0).alias("c0"), side(1).alias("c1")).filter("c0 IS NOT NULL AND c1 IS NOT NULL")


def undo_decorrelation(df: DataFrame, kind: str) -> DataFrame:
    """Left/side, side/right or mid/side pairs to left and right."""
    a, b = F.col("c0").cast("long"), F.col("c1").cast("long")
    if kind == "left_side":
        left, right = a, a - b
    elif kind == "side_right":
        left, right = a + b, b
    else:  # the sum's lost bit is the side's last one
        m = a * 2 + b.bitwiseAND(F.lit(1))
        left, right = F.shiftright(m + b, 1), F.shiftright(m - b, 1)
    return df.select("stream_id", "n", left.alias("l"), right.alias("r"))


def rotate_ms(df: DataFrame) -> DataFrame:
    """Middle/side rotation of two spectra (columns c0, c1)."""
    h = 2.0**-0.5
    return df.withColumn("l", (F.col("c0") + F.col("c1")) * h).withColumn("r", (F.col("c0") - F.col("c1")) * h).drop("c0", "c1")


def uncouple_polar(df: DataFrame) -> DataFrame:
    """Magnitude and angle spectra (c0, c1) to two channels, by their signs."""
    m, a = F.col("c0"), F.col("c1")
    first = F.when(m > 0, F.when(a > 0, m).otherwise(m + a)).otherwise(F.when(a > 0, m).otherwise(m - a))
    second = F.when(m > 0, F.when(a > 0, m - a).otherwise(m)).otherwise(F.when(a > 0, m + a).otherwise(m))
    return df.withColumn("l", first).withColumn("r", second).drop("c0", "c1")


def rematrix(df: DataFrame) -> DataFrame:
    """Sum and difference spectra to left and right."""
    return df.withColumn("l", F.col("c0") + F.col("c1")).withColumn("r", F.col("c0") - F.col("c1")).drop("c0", "c1")


def intensity(df: DataFrame, positions: DataFrame) -> DataFrame:
    """(frame, band, k, x) with intensity positions (frame, band, pos) -> left and right by the ratio of the position.

    Position 7 means no intensity there: the line stays on the left, the right is 0; bounds are checked.
    """
    ratio = F.tan(F.col("pos") * F.lit(3.141592653589793 / 12))
    left = F.when(F.col("pos") == 6, 1.0).otherwise(ratio / (1 + ratio))
    right = F.when(F.col("pos") == 6, 0.0).otherwise(1 / (1 + ratio))
    both = df.join(positions, ["frame", "band"], "left")
    live = F.col("pos").between(0, 6)
    return both.select("frame", "k", F.when(live, F.col("x") * left).otherwise(F.col("x")).alias("l"), F.when(live, F.col("x") * right).otherwise(0.0).alias("r"))
