"""Frames, envelopes, delay trimming and cross-fades of sample streams."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(df: DataFrame, size: int = 160) -> DataFrame:
    """(stream_id, frame_no, len, samples): the short tail is not padded. Positions travel with samples, so order is explicit."""
    g = df.groupBy("stream_id", F.floor(F.col("n") / size).alias("frame_no")).agg(F.array_sort(F.collect_list(F.struct("n", "s"))).alias("p"))
    return g.select("stream_id", "frame_no", F.size("p").alias("len"), F.transform("p", lambda x: x["s"]).alias("samples"))


def envelope(df: DataFrame, size: int = 800) -> DataFrame:
    """(stream_id, frame_no, peak, sum_sq, rms) of every full or partial frame."""
    s = F.col("s").cast("long")
    g = df.groupBy("stream_id", F.floor(F.col("n") / size).alias("frame_no")).agg(F.max(F.abs(s)).alias("peak"), F.sum(s * s).alias("sum_sq"), F.count("*").alias("len"))
    return g.select("stream_id", "frame_no", "peak", "sum_sq", F.sqrt(F.col("sum_sq") / F.col("len")).alias("rms"))


def looped(df: DataFrame, times: int, size: int = 160) -> DataFrame:
    """The stream's frames over and over: (stream_id, frame_no, len, samples), each turn beginning with the first sample."""
    frames = tumbling(df, size)
    turn = frames.groupBy("stream_id").agg((F.max("frame_no") + 1).alias("_turn"))
    each = frames.join(turn, "stream_id").withColumn("frame_no", F.explode(F.transform(F.sequence(F.lit(0), F.lit(times - 1)), lambda k: k * F.col("_turn") + F.col("frame_no"))))
    return each.drop("_turn")


def play(df: DataFrame, rate_in: int, rate_out: int, size: int = 160, gain: float = 1.0, start: int = 0, limit: int | None = None) -> DataFrame:
    """(stream_id, n, ch, s) -> frames of ``size`` mono samples at the player's rate, from input sample ``start`` on, ``limit`` frames at most."""
    from sonaril.operators.mixing import apply_gain
    from sonaril.operators.resample import convert

    out = convert(trim(df, start), rate_in, rate_out)
    if limit is not None:
        out = out.filter(F.col("n") < limit * size)
    return tumbling(apply_gain(out, gain) if gain != 1 else out, size)


def align_envelopes(part: DataFrame, whole: DataFrame, size: int = 800, span: int = 12) -> DataFrame:
    """(stream_id, offset): where in ``whole`` the part begins, in samples, by the least squared distance of their loudness.

    Whole frames only; the first ``span`` of the part are compared. Each frame of ``whole`` meets the ``span`` offsets that it can belong to.
    """
    loud = lambda df: envelope(df.join(df.groupBy("stream_id").agg((F.floor((F.max("n") + 1) / size)).alias("_frames")), "stream_id").filter(F.col("n") < F.col("_frames") * size).drop("_frames"), size).select("stream_id", "frame_no", "rms")
    p = loud(part).filter(F.col("frame_no") < span).withColumnRenamed("rms", "p")
    w = loud(whole)
    sizes = w.groupBy("stream_id").agg((F.max("frame_no") + 1).alias("frames")).join(p.groupBy("stream_id").agg(F.count("*").alias("spans")), "stream_id")
    met = w.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(span - 1)))).select("stream_id", (F.col("frame_no") - F.col("i")).alias("off"), F.col("i").cast("long").alias("frame_no"), "rms").filter("off >= 0")
    err = met.join(p, ["stream_id", "frame_no"]).groupBy("stream_id", "off").agg(F.sum((F.col("p") - F.col("rms")) * (F.col("p") - F.col("rms"))).alias("e"), F.count("*").alias("c"))
    fit = err.join(sizes, "stream_id").filter((F.col("c") == F.col("spans")) & (F.col("off") <= F.greatest(F.lit(0), F.col("frames") - F.col("spans"))))
    return fit.groupBy("stream_id").agg(F.min(F.struct("e", "off")).alias("m")).select("stream_id", (F.col("m.off") * size).alias("offset"))


def interleave(df: DataFrame, channels: int) -> DataFrame:
    """(stream_id, n, ch, x) -> (stream_id, n, x): samples of all channels in turn; what a channel lacks is 0, channels beyond are dropped."""
    each = df.filter(F.col("ch") < channels)
    whole = each.groupBy("stream_id", "n").agg(F.map_from_entries(F.collect_list(F.struct("ch", "x"))).alias("m"))
    row = whole.select("stream_id", "n", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(channels - 1)), lambda c: F.coalesce(F.try_element_at("m", c), F.lit(0.0)))).alias("c", "x"))
    return row.select("stream_id", (F.col("n") * channels + F.col("c")).alias("n"), "x")


def trim(df: DataFrame, front: int, keep: int | None = None) -> DataFrame:
    """Drop the first ``front`` samples, keep at most ``keep``, number anew: a filter, no shuffle."""
    live = F.col("n") >= front
    if keep is not None:
        live &= F.col("n") < front + keep
    return df.filter(live).withColumn("n", F.col("n") - front)


def celt_window(size: int = 120) -> list[float]:
    """The power-complementary window."""
    return [math.sin(math.pi / 2 * math.sin(math.pi / 2 * (i + 0.5) / size) ** 2) for i in range(size)]


def crossfade(old: DataFrame, new: DataFrame, size: int = 120) -> DataFrame:
    """w^2 * new + (1 - w^2) * old over the first ``size`` samples of each stream; afterwards the new one."""
    spark = old.sparkSession
    w = spark.createDataFrame([(i, v * v) for i, v in enumerate(celt_window(size))], "n long, w double")  # ``size`` rows
    both = old.withColumnRenamed("s", "a").join(new.withColumnRenamed("s", "b"), ["stream_id", "n"]).join(F.broadcast(w), "n", "left")
    return both.select("stream_id", "n", F.when(F.col("w").isNull(), F.col("b").cast("double")).otherwise(F.col("w") * F.col("b") + (1 - F.col("w")) * F.col("a")).alias("y"))
