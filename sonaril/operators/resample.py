"""Windowed-sinc rate conversion on blocks of samples.

Output j stands at p = half + j * in / out; it is the sum over the inputs within ``half`` of p of the
sample times the kernel's tabulated weight, read with linear interpolation. p's fraction takes as many
values as the reduced output rate, so the weights are a fixed table, one array per fraction. Samples come
together as arrays, one row per block with the few samples after it; a block's outputs are sums over
slices of it and their weights, taken inside the row. Streams have running numbers. Output begins where the kernel is fully inside.
"""

from __future__ import annotations

import math
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ZEROS, DENSITY = 12, 64
OUTPUTS = 1 << 10  # outputs summed at once


def kernel_shape(rate_in: int, rate_out: int) -> tuple[float, int]:
    """Cutoff and half width in input samples."""
    cutoff = min(1.0, rate_out / rate_in)
    return cutoff, max(4, math.ceil(ZEROS / cutoff))


def kernel_table(rate_in: int, rate_out: int) -> list[float]:
    """Kernel weights, ``DENSITY`` per input sample: a sinc under a Blackman window."""
    cutoff, half = kernel_shape(rate_in, rate_out)
    out = []
    for i in range(half * DENSITY + 1):
        x = i / DENSITY
        a = math.pi * cutoff * x
        u = x / half
        w = 0.42 + 0.5 * math.cos(math.pi * u) + 0.08 * math.cos(2 * math.pi * u)
        out.append(cutoff * (1.0 if i == 0 else math.sin(a) / a) * w)
    return out


def phase_weights(rate_in: int, rate_out: int) -> list[list[float]]:
    """For each fraction r / den of p: the weights of the 2 * half + 2 inputs from floor(p) - half on."""
    _, half = kernel_shape(rate_in, rate_out)
    k = [*kernel_table(rate_in, rate_out), 0.0]
    den = Fraction(rate_in, rate_out).denominator
    out = []
    for r in range(den):
        row = []
        for t in range(2 * half + 2):
            d = abs(Fraction(t - half) - Fraction(r, den)) * DENSITY
            i = math.floor(d)
            row.append(0.0 if i >= half * DENSITY else (1 - float(d - i)) * k[i] + float(d - i) * k[i + 1])
        out.append(row)
    return out


@lru_cache(4)
def phase_matrix(rate_in: int, rate_out: int) -> np.ndarray:
    return np.array(phase_weights(rate_in, rate_out))


def resample(df: DataFrame, rate_in: int, rate_out: int, block: int = 1 << 12) -> DataFrame:
    """(stream_id, n, s) -> (stream_id, n, s) at the other rate, tail flushed."""
    _, half = kernel_shape(rate_in, rate_out)
    step = Fraction(rate_in, rate_out)
    num, den = F.lit(step.numerator).cast("long"), step.denominator
    size = max(block, 4 * half)
    at = F.floor(F.col("n") / size)
    # a block's outputs start inside it and reach 2 * half + 1 samples beyond
    early = (F.pmod(F.col("n"), F.lit(size)) < 2 * half + 2) & (F.col("n") >= size)
    spread = df.select("stream_id", "n", "s", F.explode(F.when(early, F.array(at, at - 1)).otherwise(F.array(at))).alias("block"))
    blocks = spread.groupBy("stream_id", "block").agg(F.array_sort(F.collect_list(F.struct("n", "s"))).alias("x"))
    blocks = blocks.select("stream_id", "block", F.transform("x", lambda v: v["s"].cast("double")).alias("x"), (F.element_at("x", -1)["n"] + 1).alias("end"))
    first = F.col("block") * size
    # outputs j with floor(j * num / den) in the block, while half + j * num / den is before the stream's end
    j0 = F.ceil(first * den / num).cast("long")
    j1 = F.least(F.ceil((first + size) * den / num), F.ceil((F.col("end") - half) * den / num)).cast("long") - 1
    outs = blocks.select("stream_id", "x", j0.alias("j0"), j1.alias("j1"), first.cast("long").alias("first")).filter("j1 >= j0")

    def run(batches):
        weights = phase_matrix(rate_in, rate_out)  # a fixed table: a row per fraction
        taps = np.arange(2 * half + 2)
        for b in batches:
            j0, j1, base = (np.asarray(b.column(c)) for c in (2, 3, 4))
            out = []
            for i in range(b.num_rows):
                x = np.concatenate((np.asarray(b.column(1)[i].values), np.zeros(2 * half + 2)))
                j = np.arange(j0[i], j1[i] + 1)
                at = j * step.numerator // den - base[i]
                y = np.concatenate([(x[at[k : k + OUTPUTS, None] + taps] * weights[j[k : k + OUTPUTS] * step.numerator % den]).sum(axis=1) for k in range(0, len(j), OUTPUTS)])
                out.append(np.clip(np.rint(y), -32768, 32767).astype(np.int32))
            ends = np.concatenate(([0], np.cumsum(j1 - j0 + 1))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(out) if out else np.zeros(0, np.int32)))], names=["stream_id", "j0", "y"])

    made = outs.mapInArrow(run, f"stream_id {df.schema['stream_id'].dataType.simpleString()}, j0 long, y array<int>")
    return made.select("stream_id", "j0", F.posexplode("y").alias("i", "s")).select("stream_id", (F.col("j0") + F.col("i")).alias("n"), "s")


def convert(df: DataFrame, rate_in: int, rate_out: int) -> DataFrame:
    """Any number of channels (stream_id, n, ch, s): downmixed, then resampled."""
    from sonaril.operators.mixing import downmix

    return resample(downmix(df), rate_in, rate_out)
