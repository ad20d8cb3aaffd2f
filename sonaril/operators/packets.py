"""Packets of containers: reassembly, lacing, chunk tables and offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonaril.operators.ordering import BLOCK, carry, previous, running_sum


def lace(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """(stream_id, seg, size, first_serial...) lacing values -> (stream_id, packet_no, size, complete).

    A value of 255 goes on; the packet's number is the number of values below 255 before it.
    """
    numbered = running_sum(df, ["stream_id"], "seg", (F.col("size") < 255).cast("int"), "packet_no", exclusive=True, block=block)
    return numbered.groupBy("stream_id", "packet_no").agg(F.sum("size").alias("size"), F.max((F.col("size") < 255).cast("int")).cast("boolean").alias("complete"))


def reassemble(fragments: DataFrame, block: int = BLOCK) -> DataFrame:
    """(stream_id, serial, seq, complete, granule, data) page fragments in order -> packets of each stream's first serial.

    A fragment that isn't complete goes on in the next one. An unfinished last packet is dropped.
    """
    first = fragments.groupBy("stream_id").agg(F.min_by("serial", "seq").alias("serial"))
    mine = fragments.join(first, ["stream_id", "serial"])
    numbered = running_sum(mine, ["stream_id"], "seq", F.col("complete").cast("int"), "packet_no", exclusive=True, block=block)
    g = numbered.groupBy("stream_id", "packet_no").agg(F.array_sort(F.collect_list(F.struct("seq", "data"))).alias("p"), F.max(F.col("complete").cast("int")).alias("whole"), F.max_by("granule", "seq").alias("granule"))
    data = F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["data"])), ""))
    return g.filter("whole = 1").select("stream_id", "packet_no", "granule", data.alias("payload"))


def asof(left: DataFrame, right: DataFrame, by: list[str], at: str, since: str, values: list[str], block: int = BLOCK) -> DataFrame:
    """Each left row with the values of the last right row whose ``since`` is not after its ``at`` (whole numbers).

    Both sides are laid in one order and the last right row is carried on, by blocks: no range join.
    """
    r = right.select(*by, F.col(since).cast("long").alias(at), F.lit(0).alias("_side"), F.struct(*values).alias("_v"), F.lit(None).cast("string").alias("_row"))
    keep = [c for c in left.columns if c not in by and c != at]
    l = left.select(*by, F.col(at).cast("long").alias(at), F.lit(1).alias("_side"), F.lit(None).cast(r.schema["_v"].dataType).alias("_v"), F.struct(*keep, F.lit(1).alias("_")).alias("_row"))
    r = r.withColumn("_row", F.lit(None).cast(l.schema["_row"].dataType))
    both = carry(l.unionByName(r), by, at, "_v", "_got", ties=["_side"], block=block).filter("_side = 1")
    return both.select(*by, F.col(at).cast(left.schema[at].dataType).alias(at), *[F.col(f"_row.{c}").alias(c) for c in keep], *[F.col(f"_got.{v}").alias(v) for v in values])


def chunk_samples(chunks: DataFrame, entries: DataFrame) -> DataFrame:
    """(stream_id, chunk) with runs (stream_id, first_chunk, per_chunk) -> samples of each chunk and the number before it."""
    got = asof(chunks, entries, ["stream_id"], "chunk", "first_chunk", ["per_chunk"])
    return running_sum(got, ["stream_id"], "chunk", "per_chunk", "first_sample", exclusive=True)


def sample_offsets(samples: DataFrame) -> DataFrame:
    """(chunk, i, size) -> byte offset of every sample in its chunk."""
    w = Window.partitionBy("chunk").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return samples.withColumn("offset", F.coalesce(F.sum("size").over(w), F.lit(0)).cast("long"))


def last_known(df: DataFrame, by: list[str], order: str, value: str, block: int = BLOCK) -> DataFrame:
    """Carry a value over rows that reuse it (null)."""
    return carry(df, by, order, value, "_known", block=block).withColumn(value, F.col("_known")).drop("_known")


def main_data(frames: DataFrame, block: int = BLOCK) -> DataFrame:
    """(stream_id, frame, size, back) -> also (start, whole): the bit reservoir as a prefix sum.

    A frame's main data starts ``back`` bytes before its own in the stream's concatenated main data; where those
    lie before the stream's first byte (after a seek), the frame can't be decoded whole.
    """
    before = running_sum(frames, ["stream_id"], "frame", "size", "_before", exclusive=True, block=block)
    start = F.col("_before") - F.col("back")
    return before.withColumn("start", start).withColumn("whole", start >= 0).drop("_before")


def packet_times(packets: DataFrame, block: int = BLOCK) -> DataFrame:
    """(stream_id, packet, size): block sizes -> also (samples, time): a packet gives a quarter of its own and the last block.

    The first packet of a stream, and packets of size 0 (no audio), give nothing.
    """
    audio = previous(packets.filter("size > 0"), ["stream_id"], "packet", ["size"], block)
    counted = audio.withColumn("samples", F.coalesce(F.floor((F.col("prev_size") + F.col("size")) / 4), F.lit(0)).cast("long")).drop("prev_size")
    return running_sum(counted, ["stream_id"], "packet", "samples", "time", exclusive=True, block=block)


def opus_audio(packets: DataFrame) -> DataFrame:
    """(stream_id, packet_no, granule, payload) of Ogg files -> (stream_id, head, packets, last_granule, keep) of those with a head.

    The first packet is the head and the second the tags; ``keep`` samples stay after the pre-skip (null: all).
    """
    from sonaril.functions.headers import opus_head

    g = packets.groupBy("stream_id").agg(
        F.max(F.when(F.col("packet_no") == 0, F.col("payload"))).alias("first"),
        F.count_if(F.col("packet_no") >= 2).alias("packets"),
        F.max_by("granule", "packet_no").alias("last_granule"),
    )
    head = opus_head("first")
    keep = F.when(F.col("last_granule") != 0, F.greatest(F.lit(0), F.col("last_granule") - head["pre_skip"]))
    return g.select("stream_id", head.alias("head"), "packets", "last_granule", keep.alias("keep")).filter("head IS NOT NULL")


def log_add_term(h: Column) -> Column:
    """What the higher of two levels grows by, h being half their distance: 128 steps are 6 dB, rounded down."""
    return F.floor(F.log10(1 + F.pow(F.lit(10.0), h * (-6 / 640))) * (1280 / 6)).cast("int")


def log_add(df: DataFrame, values: str = "psd") -> DataFrame:
    """(frame, psd array<int>) -> band level: an ordered fold, as the sum of levels isn't associative.

    A level grows by the curve at h, half the difference to the next value, at most 255.
    """

    def step(acc, x):
        top = F.greatest(acc, x)
        h = F.least(top - F.shiftright(acc + x, 1), F.lit(255))
        return (top + log_add_term(h)).cast("int")

    return df.withColumn("level", F.aggregate(F.expr(f"slice({values}, 2, greatest(size({values}) - 1, 0))"), F.get(values, F.lit(0)), step))
