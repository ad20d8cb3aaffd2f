"""Readings of the driver's tables as audio: the inputs of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonaril.functions.pcm import clamp16
from sonaril.operators.ordering import ordinal


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sig(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream_id, n, s): one stream per event type."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("stream_id"), "event_id", clamp16(F.rint(F.col("value") * 100) - 16384).alias("s"))
    return ordinal(e, ["stream_id"], "event_id").select("stream_id", "n", "s")


def stereo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream_id, n, ch, s): the same samples as interleaved pairs."""
    return sig(spark, sf_dir).select("stream_id", F.floor(F.col("n") / 2).alias("n"), (F.col("n") % 2).cast("int").alias("ch"), "s")


def mixsrc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(n, source, s, gain): line items as sources of a mix."""
    l = table(spark, sf_dir, "lineitem")
    return l.select(F.col("l_orderkey").alias("n"), F.col("l_linenumber").alias("source"), clamp16(F.rint(F.col("l_extendedprice") / 2) - 26000).alias("s"), (1 - F.col("l_discount")).alias("gain"))


def spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, k, x): embeddings as spectra of 64 lines."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), F.posexplode("embedding").alias("k", "x"))
    return e.select("frame", "k", F.col("x").cast("double").alias("x"))
