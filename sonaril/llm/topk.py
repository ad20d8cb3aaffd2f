"""Exact top-k search by inner product: distributed histogram selection.

Queries are taken in groups of bounded size (``GROUP`` bytes of vectors); a group is broadcast and every
(query, candidate) pair is scored where the candidates lie, by integer matrix products, so no candidate is ever
shuffled or copied. Each round counts the scores of every query in ``BINS`` equal bins over its current
score range; the bin that holds the k-th value becomes the next range, until ranges are one
integer wide. Scores at or above the k-th value are then filtered and ranked, ties to the smaller id.

Exactness: a task passes on only its own k highest scores of a range (and its own k smallest ids of a
score), because the k best of a task decide all that the task can add to the global k best.

Edges: vectors that are null, hold null or non-finite components, or have a null id take no part;
shorter vectors count as padded with zeros; a repeated query id is searched once, with the smallest
of its vectors; every row with the query's own id is its own row and never its candidate; repeated
candidate rows count as rows. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonaril.llm.common import Scratch

BINS = 4096
QUERY_BLOCK = 256
CANDIDATE_BLOCK = 2048
GROUP = 1 << 25


def quantise(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(vec_id, v array<long>) of the rows that take part: floor(scale * x) of every component."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.col(id_col).isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.filter(fine).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * scale)).alias("v"))


def _matrix(vectors, dim: int) -> np.ndarray:
    m = np.zeros((len(vectors), dim), np.int64)
    for r, v in enumerate(vectors):
        m[r, : len(v)] = v
    return m


def _pack(frames, dim: int, block: int):
    """Rows -> (ids bytes, matrix bytes) of at most ``block`` vectors."""
    for pdf in frames:
        for i in range(0, len(pdf), block):
            part = pdf.iloc[i : i + block]
            yield pd.DataFrame({"ids": [part["vec_id"].to_numpy(np.int64).tobytes()], "mat": [_matrix(part["v"], dim).tobytes()]})


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products: through doubles while every partial sum stays below 2**53."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64) if bound < 2**53 else q @ c.T


class Group(NamedTuple):
    """Queries of a group and the score range [lo, hi) of each that still holds its k-th value, in bins of ``width``."""

    ids: np.ndarray
    mat: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    width: np.ndarray

    def blocks(self, frames):
        """(first query, candidate ids, scores, which are no candidates) of every block of queries and of candidates."""
        for pdf in frames:
            for ids, mat in zip(pdf["ids"], pdf["mat"], strict=True):
                cids = np.frombuffer(ids, np.int64)
                c = np.frombuffer(mat, np.int64).reshape(len(cids), -1)
                for i in range(0, len(self.ids), QUERY_BLOCK):
                    yield i, cids, _scores(self.mat[i : i + QUERY_BLOCK], c), self.ids[i : i + QUERY_BLOCK, None] == cids[None, :]


_LEAST = np.iinfo(np.int64).min


def _histogram(frames, group: Group, k: int):
    """(q, bin, n): of each query's range, the bins of the task's k highest scores."""
    best = np.full((len(group.ids), k), _LEAST)
    for i, _, s, own in group.blocks(frames):
        j = slice(i, i + len(s))
        s = np.where(own | (s < group.lo[j, None]) | (s >= group.hi[j, None]), _LEAST, s)
        both = np.concatenate((best[j], s), axis=1)
        best[j] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
    q, at = np.nonzero(best > _LEAST)
    if len(q):
        pairs = pd.DataFrame({"q": q.astype(np.int32), "bin": (best[q, at] - group.lo[q]) // group.width[q]})
        yield pairs.groupby(["q", "bin"]).size().reset_index(name="n")


def _select(frames, group: Group, k: int):
    """(query_id, vec_id, score) at or above each query's k-th value; of a block's own rows the k best suffice."""
    for i, cids, s, own in group.blocks(frames):
        q, at = np.nonzero(~own & (s >= group.lo[i : i + len(s), None]))
        if len(q):
            ids, score = cids[at], s[q, at]
            order = np.lexsort((ids, -score, q))
            q, ids, score = q[order], ids[order], score[order]
            first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
            place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
            top = place < k
            yield pd.DataFrame({"query_id": group.ids[i + q[top]], "vec_id": ids[top], "score": score[top]})


def _kth(packed: DataFrame, group: Group, k: int) -> Group:
    """The group with ``lo`` at each query's k-th highest score (its lowest one where it has fewer)."""
    sc = packed.sparkSession.sparkContext
    lo, hi, width = group.lo.copy(), group.hi.copy(), group.width.copy()
    need = np.full(len(lo), k)
    while True:
        shared = sc.broadcast(group._replace(lo=lo, hi=hi, width=width))
        hist = packed.mapInPandas(lambda it, g=shared: _histogram(it, g.value, k), "q int, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        limits = packed.sparkSession.createDataFrame(pd.DataFrame({"q": np.arange(len(lo), dtype=np.int32), "need": need}))
        above = F.coalesce(F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        # the bin where the running count from above reaches what is needed; the lowest occupied one if there are fewer rows
        hit = hist.withColumn("above", above).join(F.broadcast(limits), "q").filter("above < need").groupBy("q").agg(F.min("bin").alias("bin"), F.max_by("above", F.struct(-F.col("bin"))).alias("above")).toPandas()  # a row per query of the group
        shared.unpersist()
        q, exact = hit["q"].to_numpy(), bool((width[hit["q"].to_numpy()] <= 1).all())
        lo[q] += hit["bin"].to_numpy() * width[q]
        hi[q] = np.minimum(hi[q], lo[q] + width[q])
        need[q] -= hit["above"].to_numpy()
        width = np.maximum(1, -(-(hi - lo) // BINS))
        if exact:
            return group._replace(lo=lo, hi=hi, width=width)


def top_k(df: DataFrame, k: int = 10, scale: int = 1024, query_mod: int = 100, id_col: str = "vec_id", vec_col: str = "embedding", queries: DataFrame | None = None, group_bytes: int = GROUP) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest scores over all rows.

    Queries are the rows of ``queries`` or, without it, those whose id is divisible by ``query_mod``.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    tmp = Scratch(spark, "topk")
    rows = quantise(df, id_col, vec_col, scale)
    qrows = quantise(queries, id_col, vec_col, scale) if queries is not None else rows.filter(F.col("vec_id") % query_mod == 0)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    q = tmp.table(qrows.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("norm", norm), "queries")
    dim, most = rows.agg(F.max(F.size("v")), F.max(norm)).first()  # two numbers
    n_q, widest = q.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n_q or dim is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = max(int(dim), widest, 1)
    packed = tmp.table(rows.mapInPandas(lambda it: _pack(it, dim, CANDIDATE_BLOCK), "ids binary, mat binary"), "candidates")
    groups = math.ceil(n_q * dim * 8 / group_bytes)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = None
    for g in range(groups):
        mine = q.filter(F.pmod(F.xxhash64("vec_id"), F.lit(groups)) == g).toPandas()  # a group: bounded
        if not len(mine):
            continue
        reach = np.floor(mine["norm"].to_numpy() * float(most)).astype(np.int64) + 1
        hi = reach + 1
        group = Group(mine["vec_id"].to_numpy(np.int64), _matrix(mine["v"], dim), -reach, hi, np.maximum(1, -(-(hi + reach) // BINS)))
        shared = sc.broadcast(_kth(packed, group, k))
        found = packed.mapInPandas(lambda it, s=shared: _select(it, s.value, k), "query_id long, vec_id long, score long")
        ranked = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if groups > 1:
            ranked = tmp.table(ranked, f"found{g}")
        out = ranked if out is None else out.unionByName(ranked)
    return out
