"""Ordinals and running sums along long streams without one task per stream.

A stream is cut in blocks of its order column; block totals are summed ahead of each block (one row
per block), and windows run inside blocks only. A stream with a third of all rows is many blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16


def _blocked(df: DataFrame, order: str, block: int) -> DataFrame:
    return df.withColumn("_block", F.floor(F.col(order) / block))


def _before(totals: DataFrame, by: list[str], value: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn(value, F.coalesce(F.sum(value).over(w), F.lit(0)))


def ordinal(df: DataFrame, by: list[str], order: str, out: str = "n", block: int = BLOCK) -> DataFrame:
    """Zero-based position of every row in its stream, by a numeric order column without ties."""
    b = _blocked(df, order, block)
    ahead = _before(b.groupBy(*by, "_block").agg(F.count("*").alias("_ahead")), by, "_ahead")
    w = Window.partitionBy(*by, "_block").orderBy(order)
    joined = b.withColumn("_at", F.row_number().over(w)).join(ahead, [*by, "_block"])
    return joined.withColumn(out, (F.col("_ahead") + F.col("_at") - 1).cast("long")).drop("_block", "_ahead", "_at")


def running_sum(df: DataFrame, by: list[str], order: str, value: Column | str, out: str, exclusive: bool = False, block: int = BLOCK) -> DataFrame:
    """Sum of an integer column up to (or before) every row of its stream."""
    v = F.col(value) if isinstance(value, str) else value
    b = _blocked(df, order, block).withColumn("_v", v.cast("long"))
    ahead = _before(b.groupBy(*by, "_block").agg(F.sum("_v").alias("_ahead")), by, "_ahead")
    w = Window.partitionBy(*by, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("_v").over(w)
    inside = b.withColumn("_in", total - F.col("_v") if exclusive else total).join(ahead, [*by, "_block"])
    return inside.withColumn(out, (F.col("_ahead") + F.col("_in")).cast("long")).drop("_block", "_v", "_ahead", "_in")


def carry(df: DataFrame, by: list[str], order: str, value: str, out: str, ties: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """The last value that isn't null up to every row of its stream (``ties``: further order columns).

    One row per block, its last value, is carried ahead; rows look back inside their block only.
    """
    b = _blocked(df, order, block)
    rank = F.struct(order, *(ties or []))
    last = b.filter(F.col(value).isNotNull()).groupBy(*by, "_block").agg(F.max_by(value, rank).alias("_last"))
    some = b.select(*by, "_block").distinct().join(last, [*by, "_block"], "left")
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = some.select(*by, "_block", F.last("_last", ignorenulls=True).over(before).alias("_ahead"))
    w = Window.partitionBy(*by, "_block").orderBy(order, *(ties or [])).rowsBetween(Window.unboundedPreceding, 0)
    inside = b.withColumn("_in", F.last(value, ignorenulls=True).over(w)).join(ahead, [*by, "_block"])
    return inside.withColumn(out, F.coalesce("_in", "_ahead")).drop("_block", "_in", "_ahead")


def previous(df: DataFrame, by: list[str], order: str, values: list[str], block: int = BLOCK) -> DataFrame:
    """Columns prev_<value> of the row before in the stream: inside its block, or the last row of the block before."""
    b = _blocked(df, order, block)
    row = F.struct(*values)
    ends = b.groupBy(*by, "_block").agg(F.max_by(row, order).alias("_end"))
    ahead = ends.select(*by, "_block", F.lag("_end").over(Window.partitionBy(*by).orderBy("_block")).alias("_ahead"))
    inside = b.withColumn("_in", F.lag(row).over(Window.partitionBy(*by, "_block").orderBy(order))).join(ahead, [*by, "_block"])
    got = F.coalesce("_in", "_ahead")
    return inside.select("*", *[got[v].alias(f"prev_{v}") for v in values]).drop("_block", "_in", "_ahead")


def with_halo(df: DataFrame, order: str, width: int, block: int = BLOCK) -> DataFrame:
    """Rows with their block ``_block``; the last ``width`` positions of a block are in the next one, too, with ``_halo`` true."""
    at = F.floor(F.col(order) / block)
    late = F.pmod(F.col(order), F.lit(block)) >= block - width
    blocks = F.when(late, F.array(F.struct(at.alias("_block"), F.lit(False).alias("_halo")), F.struct((at + 1).alias("_block"), F.lit(True).alias("_halo")))).otherwise(F.array(F.struct(at.alias("_block"), F.lit(False).alias("_halo"))))
    return df.withColumn("_at", F.explode(blocks)).select("*", "_at._block", "_at._halo").drop("_at")
