"""PCM arithmetic on columns. Rounding is half to even; sums are made in wide integers and clipped once."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOW, HIGH = -32768, 32767


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clamp16(x: Column | str) -> Column:
    """Saturate to 16 bits, half-even."""
    return F.greatest(F.lit(LOW), F.least(F.lit(HIGH), F.rint(col(x)))).cast("int")


def gain(s: Column | str, g: Column | str | float) -> Column:
    """Scale and clip."""
    g = F.lit(g) if isinstance(g, (int, float)) else col(g)
    return clamp16(col(s) * g)


def full_scale(x: Column | str, scale: int = 32768) -> Column:
    """Unit-range floating point to PCM16; layer III and WAV sinks use 32767, the other codecs 32768."""
    return clamp16(col(x) * scale)


def to_float(s: Column | str, scale: int = 32768) -> Column:
    return (col(s).cast("double") / scale).cast("float")


def scaled_source(s: Column | str, g: Column | str) -> Column:
    """A source's part in a mix: scaled and rounded before the sum; a missing gain is 1."""
    return F.rint(F.coalesce(col(g).cast("double"), F.lit(1.0)) * col(s)).cast("long")


def silence(n: int) -> Column:
    return F.array_repeat(F.lit(0).cast("short"), n)
