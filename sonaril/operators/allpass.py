"""Bit-exact rate conversion of voice to 48 kHz: a doubling by two chains of all-pass sections, then a fractional filter.

Every section rounds and the outputs saturate, so states can't be composed: a stream's samples go through one
after the other, and a task hands the state (six sums, eight doubled samples) from piece to piece of a stream.
State and result don't depend on how a stream is cut in pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# Section coefficients of the even and the odd outputs, and the fractional filter's taps by twelfths (first half; the second mirrors it).
SECTIONS = ((1746, 14986, -26453), (6854, 25769, -9994))
TAPS = [[189, -600, 617, 30567], [117, -159, -1070, 29704], [52, 221, -2392, 28276], [-4, 529, -3350, 26341], [-48, 758, -3956, 23973], [-80, 905, -4235, 21254], [-99, 972, -4222, 18278], [-107, 967, -3957, 15143], [-103, 896, -3487, 11950], [-91, 773, -2865, 8798], [-71, 611, -2143, 5784], [-46, 425, -1375, 2996]]
#: Samples that a stream of each rate is delayed by.
DELAYS = {8000: 0, 12000: 4, 16000: 7}


def double(samples: list[int], state: list[int]) -> np.ndarray:
    """Twice as many samples; ``state`` (six whole numbers) moves on."""
    out = np.empty(2 * len(samples), np.int64)
    for parity, (a, b, c) in enumerate(SECTIONS):
        s0, s1, s2 = state[3 * parity : 3 * parity + 3]
        c += 65536  # the last section's coefficient counts from one
        y = []
        for v in samples:
            v <<= 10
            t = (v - s0) * a >> 16
            u, s0 = s0 + t, v + t
            t = (u - s1) * b >> 16
            w, s1 = s1 + t, u + t
            t = (w - s2) * c >> 16
            y.append(s2 + t)
            s2 = w + t
        state[3 * parity : 3 * parity + 3] = s0, s1, s2
        out[parity::2] = y
    return np.clip((out + 512) >> 10, -32768, 32767)


def step_of(rate: int) -> int:
    """Doubled samples an output, in 65536ths: the least that never gives too many outputs."""
    step = (rate << 15) // 48000 << 2
    while step * 48000 >> 16 < rate << 1:
        step += 1
    return step


def fractional(doubled: np.ndarray, step: int) -> np.ndarray:
    """Outputs of a batch from its doubled samples with the eight before them."""
    at = np.arange(-(-((len(doubled) - 8) << 16) // step), dtype=np.int64) * step
    taps = np.array(TAPS, np.int64)
    part = (at & 0xFFFF) * 12 >> 16
    weights = np.concatenate((taps[part], taps[11 - part][:, ::-1]), axis=1)
    total = (doubled[(at >> 16)[:, None] + np.arange(8)] * weights).sum(axis=1)
    return np.clip((total + (1 << 14)) >> 15, -32768, 32767)


class Raiser:
    """A stream's conversion: push pieces of any size, get what is due. Filters start anew every ``ms`` of a frame: after 1, then 10 each."""

    def __init__(self, rate: int, frame: int):
        self.rate, self.frame, self.step = rate, frame, step_of(rate)
        k = rate // 1000
        edges = [0, k, *range(11 * k, frame, 10 * k), frame]
        self.sizes = [z - a for a, z in zip(edges, edges[1:], strict=False) if z > a]
        self.sections, self.last = [0] * 6, np.zeros(8, np.int64)
        self.held: list[int] = [0] * DELAYS[rate]
        self.batch = self.done = 0

    def push(self, samples: list[int], final: bool = False) -> np.ndarray:
        self.held += samples
        out = []
        while len(self.held) >= (size := self.sizes[self.batch]) or final and self.held:
            now, self.held = self.held[:size], self.held[size:]
            doubled = np.concatenate((self.last, double(now, self.sections)))
            out.append(fractional(doubled, self.step))
            self.last, self.batch = doubled[-8:], (self.batch + 1) % len(self.sizes)
        y = np.concatenate(out) if out else np.zeros(0, np.int64)
        self.done += len(y)
        return y

    def state(self) -> tuple:
        return self.sections, self.last.tolist(), self.held, self.batch, self.done

    def resume(self, state: tuple) -> Raiser:
        self.sections, self.held, self.batch, self.done = list(state[0]), list(state[2]), state[3], state[4]
        self.last = np.array(state[1], np.int64)
        return self


def _along(df: DataFrame, start, push, piece: int) -> DataFrame:
    """(stream_id, n, s) through a state per stream, piece after piece: (stream_id, n, s). Streams are dealt to tasks; a task holds a piece and the one after it.

    Streams are dealt by a struct of their id: Spark leaves out a repartition by a column that the rows come dealt by
    already, and may then read that earlier shuffle piecemeal, which cuts a stream over tasks.
    """
    sid = df.schema["stream_id"].dataType.simpleString()
    listed = df.groupBy("stream_id", F.floor(F.col("n") / piece).alias("at")).agg(F.array_sort(F.collect_list(F.struct("n", F.col("s").cast("int").alias("s")))).alias("x"))
    ready = listed.select("stream_id", "at", F.transform("x", lambda v: v["s"]).alias("x"))

    def pieces(rows) -> Iterator[tuple]:
        for b in rows:
            for i in range(b.num_rows):
                yield b.column(0).slice(i, 1), b.column(2)[i].as_py()
        yield None, None

    def run(rows) -> Iterator[pa.RecordBatch]:
        key, state, done = (), None, 0
        for (sid, x), (after, _) in pairwise(pieces(rows)):
            own = (sid[0].as_py(),)
            if own != key:
                key, state, done = own, start(), 0
            y = push(state, x, after is None or (after[0].as_py(),) != own)
            yield pa.RecordBatch.from_arrays([sid.take(pa.array(np.zeros(len(y), np.int64))), pa.array(np.arange(done, done + len(y))), pa.array(y.astype(np.int32))], names=["stream_id", "n", "s"])
            done += len(y)

    return ready.repartition(F.struct("stream_id")).sortWithinPartitions("stream_id", "at").mapInArrow(run, f"stream_id {sid}, n long, s int")


def double_rate(df: DataFrame, piece: int = 1 << 12) -> DataFrame:
    """(stream_id, n, s) -> (stream_id, n, s) at twice the rate."""
    return _along(df, lambda: [0] * 6, lambda state, x, final: double(x, state), piece)


def raise_rate(df: DataFrame, rate: int, frame_ms: int = 20, piece: int = 1 << 12) -> DataFrame:
    """(stream_id, n, s) at 8, 12 or 16 kHz -> (stream_id, n, s) at 48 kHz, framed as the coder's frames are."""
    return _along(df, lambda: Raiser(rate, rate // 1000 * frame_ms), lambda state, x, final: state.push(x, final), piece)


# --------------------------------------------------------------------------- predictive mid and side
def unmix_predicted(df: DataFrame, weights: DataFrame, frame: int, ramp: int, block: int = 1 << 16) -> DataFrame:
    """(stream_id, n, mid, side) and (stream_id, frame, p0, p1) -> (stream_id, n, l, r), a sample late.

    The side gets back what was predicted from the mid around it, smoothed and plain, by weights of 13 bits that ramp from the
    last frame's to this one's over the first ``ramp`` samples. Only two samples are looked back on, so windows stay inside blocks.
    """
    from pyspark.sql import Window

    from sonaril.functions.fixed import saturate16, smlawb
    from sonaril.operators.ordering import previous, with_halo

    w = Window.partitionBy("stream_id", "_block").orderBy("n")
    lag = lambda c, k: F.coalesce(F.lag(c, k).over(w), F.lit(0)).cast("long")
    near = with_halo(df.select("stream_id", "n", "mid", "side"), "n", 2, block).select("*", lag("mid", 2).alias("a"), lag("mid", 1).alias("b"), lag("side", 1).alias("d")).filter(~F.col("_halo"))
    steps = previous(weights.select("stream_id", "frame", "p0", "p1"), ["stream_id"], "frame", ["p0", "p1"], block)
    rounded = lambda x, k: F.shiftright(F.shiftright(x, k - 1) + 1, 1)
    first = {p: F.coalesce(f"prev_{p}", F.lit(0)) for p in ("p0", "p1")}
    slopes = steps.select("stream_id", "frame", *(x for p in ("p0", "p1") for x in (F.col(p), first[p].alias(f"{p}_from"), rounded((F.col(p) - first[p]).cast("long") * ((1 << 16) // ramp), 16).alias(f"{p}_step"))))
    at = near.withColumn("frame", F.floor(F.col("n") / frame)).withColumn("i", F.col("n") % frame).join(slopes, ["stream_id", "frame"])
    now = lambda p: F.when(F.col("i") < ramp, F.col(f"{p}_from") + (F.col("i") + 1) * F.col(f"{p}_step")).otherwise(F.col(p))
    smooth = (F.col("a") + F.col("mid") + 2 * F.col("b")) * 512
    total = smlawb(smlawb(F.col("d") * 256, smooth, now("p0")), F.col("b") * 2048, now("p1"))
    back = at.withColumn("e", saturate16(rounded(total, 8)))
    return back.select("stream_id", "n", saturate16(F.col("b") + F.col("e")).cast("int").alias("l"), saturate16(F.col("b") - F.col("e")).cast("int").alias("r"))


# --------------------------------------------------------------------------- digest of samples
def sample_digest(df: DataFrame, depth: int, block: int = 1 << 14) -> DataFrame:
    """(stream_id, n, ch, s) -> (stream_id, n_bytes, md5): the digest of interleaved samples of ``depth`` bits, in whole bytes, low byte first.

    Blocks are packed where they are; a stream's blocks pass through its digest in order, which holds nothing but its state.
    """
    import hashlib

    sid = df.schema["stream_id"].dataType.simpleString()
    width = -(-depth // 8)
    listed = df.groupBy("stream_id", F.floor(F.col("n") / block).alias("at")).agg(F.array_sort(F.collect_list(F.struct("n", "ch", F.col("s").cast("long").alias("s")))).alias("x"))
    packed = listed.select("stream_id", "at", F.transform("x", lambda v: v["s"]).alias("x"))

    def pack(rows):
        for b in rows:
            out = [np.asarray(x.values).astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes() for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], names=["stream_id", "at", "body"])

    def digest(rows):
        key, h, size = None, None, 0
        ids: list[pa.Array] = []
        done: list[tuple[int, str]] = []
        for b in rows:
            for i, body in enumerate(b.column(2).to_pylist()):
                own = (b.column(0)[i].as_py(),)
                if own != key:
                    if key is not None:
                        done.append((size, h.hexdigest()))
                    key, h, size = own, hashlib.md5(usedforsecurity=False), 0
                    ids.append(b.column(0).slice(i, 1))
                h.update(body)
                size += len(body)
        if key is not None:
            done.append((size, h.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.array([n for n, _ in done], pa.int64()), pa.array([x for _, x in done])], names=["stream_id", "n_bytes", "md5"])

    blocks = packed.mapInArrow(pack, f"stream_id {sid}, at long, body binary")
    return blocks.repartition("stream_id").sortWithinPartitions("stream_id", "at").mapInArrow(digest, f"stream_id {sid}, n_bytes long, md5 string")
