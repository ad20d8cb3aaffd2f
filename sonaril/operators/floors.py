"""Points of a floor curve and the routing of channels, as array folds and small groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def argsort(x: Column | str) -> Column:
    """Positions of an array's values in rising order."""
    x = F.col(x) if isinstance(x, str) else x
    return F.transform(F.array_sort(F.transform(x, lambda v, i: F.struct(v.alias("v"), i.alias("i")))), lambda p: p["i"])


def is_distinct(x: Column | str) -> Column:
    """Whether no value of an array stands twice."""
    x = F.col(x) if isinstance(x, str) else x
    return F.size(F.array_distinct(x)) == F.size(x)


def neighbours(x: Column | str) -> Column:
    """For each point from the third on: positions of the nearest points placed before it, below and above (array of struct low, high)."""
    x = F.col(x) if isinstance(x, str) else x
    at = F.transform(x, lambda v, i: F.struct(v.alias("v"), i.alias("i")))

    def pair(p: Column) -> Column:
        before = F.slice(at, F.lit(1), p["i"])
        low = F.array_max(F.transform(F.filter(before, lambda q: q["v"] < p["v"]), lambda q: F.struct(q["v"].alias("v"), (-q["i"]).alias("i"))))
        high = F.array_min(F.filter(before, lambda q: q["v"] > p["v"]))
        return F.struct((-low["i"]).alias("low"), high["i"].alias("high"))

    return F.transform(F.slice(at, F.lit(3), F.greatest(F.size(at) - 2, F.lit(0))), pair)


def submap_channels(mux: DataFrame) -> DataFrame:
    """(mapping, ch, submap) -> (mapping, submap, channels): the channels of each submap in order."""
    return mux.groupBy("mapping", "submap").agg(F.array_sort(F.collect_list("ch")).alias("channels"))


def used_channels(used: DataFrame, pairs: DataFrame) -> DataFrame:
    """(frame, ch, used) with coupled pairs (a, b) of channels -> the same, a pair's halves both used if either is."""
    sides = pairs.select(F.col("a").alias("ch"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("ch"), F.col("a").alias("other")))
    other = used.select("frame", F.col("ch").alias("other"), F.col("used").alias("_also"))
    met = used.join(F.broadcast(sides), "ch", "left").join(other, ["frame", "other"], "left")  # a row per channel of a mapping
    return met.groupBy("frame", "ch").agg(F.bool_or(F.col("used") | F.coalesce("_also", F.lit(False))).alias("used"))


def space_apart(x: Column | str, least: list[int], top: int = 1 << 15) -> Column:
    """An array sorted, then pushed up and back down so that values keep their least distances (the first from 0, the last from ``top``)."""
    x = F.array_sort(F.col(x) if isinstance(x, str) else x)
    n = len(least) - 1
    values = [F.get(x, F.lit(i)) for i in range(n)]
    up = F.aggregate(
        F.array(*[F.struct(v.alias("v"), F.lit(d).cast("long").alias("d")) for v, d in zip(values, least[:n], strict=True)]),
        F.array().cast("array<bigint>"),
        lambda acc, p: F.concat(acc, F.array(F.greatest(p["v"].cast("long"), F.least(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + p["d"], F.lit(32767))))),
    )
    down = F.aggregate(
        F.reverse(F.arrays_zip(up.alias("v"), F.array(*[F.lit(d).cast("long") for d in least[1:]]).alias("d"))),
        F.array().cast("array<bigint>"),
        lambda acc, p: F.concat(acc, F.array(F.least(p["v"], F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(top).cast("long")) - p["d"]))),
    )
    return F.reverse(down)


# --------------------------------------------------------------------------- residues
def residue(entries: DataFrame, classes: DataFrame, books: DataFrame, values: DataFrame, size: int, layout: int, channels: int = 1, begin: int = 0, lines: int | None = None) -> DataFrame:
    """Vectors of several passes summed into lines: (frame, ch, k, x).

    ``entries`` (frame, ch, part, pass, i, entry): the i-th code of a partition of ``size`` lines in a pass; ``classes`` (frame, ch,
    part, class); ``books`` (class, pass, book): which passes a class takes part in; ``values`` (book, entry, v array<double>).
    Layout 0 spreads a vector's numbers over its partition, 1 puts them side by side, 2 does so over all channels' lines
    interleaved (``ch`` of the input is 0 there). Lines from ``lines`` on are dropped. One sum, added up before the shuffle.
    """
    met = entries.join(classes, ["frame", "ch", "part"]).join(books, ["class", "pass"]).join(values, ["book", "entry"])
    each = met.select("frame", "ch", "part", "i", F.size("v").alias("dim"), F.posexplode("v").alias("j", "x"))
    inside = F.col("i") + F.col("j") * F.floor(F.lit(size) / F.col("dim")) if layout == 0 else F.col("i") * F.col("dim") + F.col("j")
    at = each.withColumn("p", (F.lit(begin) + F.col("part") * size + inside).cast("long"))
    if layout == 2:
        at = at.withColumn("ch", (F.col("p") % channels).cast("int")).withColumn("p", F.floor(F.col("p") / channels))
    if lines is not None:
        at = at.filter(F.col("p") < lines)
    return at.groupBy("frame", "ch", F.col("p").alias("k")).agg(F.sum("x").alias("x"))
