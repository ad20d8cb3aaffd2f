"""Connected components by alternating large-star and small-star steps on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonaril.llm.common import Scratch


def connected_components(edges: DataFrame, tmp: Scratch, name: str = "cc") -> DataFrame:
    """(node, comp) of every node with an edge (columns a, b); comp is the component's smallest node.

    Every round is two grouped minima and two joins on the edges; each round's edges are written to the
    shared folder. Converged when a round changes nothing: count and hash sum are compared.
    """
    cur = tmp.table(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}0")

    def mark(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen, i = mark(cur), 0
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        i += 1
        new = tmp.table(small, f"{name}{i}")
        got = mark(new)
        tmp.drop(f"{name}{i - 1}")
        cur = new
        if got == seen:
            break
        seen = got
    roots = cur.select(F.col("v").alias("node")).distinct()
    return tmp.table(cur.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots.select("node", F.col("node").alias("comp"))), f"{name}_out")
