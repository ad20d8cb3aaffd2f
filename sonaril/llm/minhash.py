"""Near-duplicate classes by DartMinHash.

A text is the multiset of its five-word shingles (ASCII-lower-cased words). Every shingle owns a
region: one unit of weight for each of its occurrences, times time. Hash-seeded darts arrive in each
unit as a Poisson process; a text throws the darts of its own region up to the time at which about
``DARTS`` have come, and keeps the earliest dart of each of ``K`` coordinates. Two texts agree in a
coordinate with the probability of their weighted Jaccard likeness, and the work is one hash per
unit plus the darts, not K per shingle.

Bands of ``ROWS`` coordinates give bucket keys. Texts with equal multisets are one node. Each node is
first compared exactly (weighted Jaccard of the shingle multisets) with the most central node of its
buckets, so a group of copies costs one comparison each. The nodes of buckets that still hold several
components are then compared wherever two of them could reach the threshold: such nodes share one of
their rarest units, so nodes of different components meet by those, first with central ones again,
at last all that are still apart. So of the nodes that share a band, no link that could join two
classes is left out, and texts that share a common passage don't meet. Two texts of likeness 0.8 share none of
the 32 bands with a probability of 5e-8 (0.59 to the power of 32), more alike ones with less. Links of 0.8 or more make
classes (connected components).

Edges: a text without words is no near-duplicate of anything and is its own class, named by its
doc_id; a text of one to four words is one shingle; equal texts always share a class; null ids are
classed like others (a class's name is its smallest non-null id); repeated rows share a class.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonaril.llm.common import Scratch, doc_slices, free_names, map_arrow, mix, shingle_hashes, text_chunks, word_hashes
from sonaril.llm.components import connected_components

K, ROWS, WIDTH = 128, 4, 5
DARTS = 1000
THRESHOLD = 0.8
SLOTS = 1 << 18
ROUNDS = 2

_C1, _C2, _C3 = (np.uint64(x) for x in (0x9FB21C651E98DF25, 0xD1B54A32D192ED03, 0xAEF17502108EF2D9))


# --------------------------------------------------------------------------- signatures
def unit_cells(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One hash per occurrence of every shingle, sorted within each document: the units of its region."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    if not len(h):
        return h, doc
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))
    at = np.arange(len(h))
    nth = at - np.maximum.accumulate(np.where(new, at, 0))
    return np.where(nth > 0, mix(h + nth.astype(np.uint64) * _C1), h), doc


def _arrivals(cell: np.ndarray, j: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Dart j of every unit: its hash and the waiting time before it (exponential)."""
    dart = mix(cell + (np.atleast_1d(np.asarray(j, np.uint64)) + np.uint64(1)) * _C2)
    u = ((mix(dart ^ _C3) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
    return dart, -np.log(u)


def _throw(cells: np.ndarray, doc: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All darts (document, hash, time) of the units up to each document's time limit."""
    out = []
    time = np.zeros(len(cells))
    j = 0
    while len(cells):
        dart, wait = _arrivals(cells, j)
        time = time + wait
        live = time < limit[doc]
        cells, doc, time, dart = cells[live], doc[live], time[live], dart[live]
        out.append((doc, dart, time))
        j += 1
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0))


def _earliest(doc: np.ndarray, dart: np.ndarray, time: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the earliest dart of each coordinate, and which coordinates have one."""
    at = doc * k + (mix(dart) % np.uint64(k)).astype(np.int64)
    order = np.argsort(-time, kind="stable")
    sig, full = np.zeros(n * k, np.uint64), np.zeros(n * k, bool)
    sig[at[order]] = dart[order]  # the last one written is the earliest
    full[at] = True
    return sig.reshape(n, k), full.reshape(n, k)


def signatures(cells: np.ndarray, doc: np.ndarray, n: int, k: int = K, darts: int = DARTS) -> np.ndarray:
    """n x k signatures; rows of documents without units are zero."""
    count = np.bincount(doc, minlength=n)
    sig = np.zeros((n, k), np.uint64)
    at = doc_slices(doc, n)
    short = np.flatnonzero((count > 0) & (count < 64))
    todo = np.flatnonzero(count >= 64)
    limit = darts / np.maximum(count, 1)
    while len(todo):  # a document with an empty coordinate throws twice as long; earlier darts stay the same
        pick = np.isin(doc, todo)
        d, x, t = _throw(cells[pick], doc[pick], limit)
        place = np.full(n, -1)
        place[todo] = np.arange(len(todo))
        s, full = _earliest(place[d], x, t, len(todo), k)
        done = full.all(1)
        sig[todo[done]] = s[done]
        limit[todo] *= 2
        todo = todo[~done]
    for i in short:  # many darts in few units: all arrivals of a unit at once
        c, most = cells[at[i] : at[i + 1]], limit[i]
        while True:
            j = np.arange(int(most + 8 * math.sqrt(most) + 30))
            x, wait = _arrivals(c[:, None], j[None, :])
            t = np.cumsum(wait, axis=1)
            if (t[:, -1] < most).any():  # a unit may have more darts than were drawn: settle for the time that all reach
                most = float(t[:, -1].min())
            live = t < most
            s, full = _earliest(np.zeros(int(live.sum()), np.int64), x[live], t[live], 1, k)
            if full.all():
                sig[i] = s[0]
                break
            most *= 2
    return sig


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    n, k = sig.shape
    s = sig.reshape(n, k // rows, rows)
    h = np.arange(k // rows, dtype=np.uint64)[None, :] * _C1
    salt = np.arange(1, rows + 1, dtype=np.uint64) * _C2
    for r in range(rows):
        h = mix(h ^ (s[:, :, r] + salt[r]))
    return h.view(np.int64)


def content_keys(cells: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Two 64-bit sums over a document's units: equal for equal multisets."""
    out = []
    for c in (_C1, _C3):
        s = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(cells ^ c))))
        out.append((s[at[1:]] - s[at[:-1]]).view(np.int64))
    return np.stack(out)


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Exact likeness of two sorted unit arrays (units number a shingle's occurrences, so sets of units suffice)."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared) if len(a) or len(b) else 0.0


# --------------------------------------------------------------------------- DataFrame forms
def _units(data, offs):
    cells, doc = unit_cells(*shingle_hashes(*word_hashes(data, offs), WIDTH))
    return cells, doc, doc_slices(doc, len(offs) - 1)


def sign(docs: DataFrame) -> DataFrame:
    """(doc_id, t, k1, k2, units, bands) of every row, t being its text's hash; no shuffle."""

    def kernel(b):
        for part, data, offs in text_chunks(b):
            n = part.num_rows
            cells, doc, at = _units(data, offs)
            k1, k2 = content_keys(cells, at)
            bands = band_keys(signatures(cells, doc, n))
            per = bands.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * per + 1, per, dtype=np.int32)), pa.array(bands.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(k1), pa.array(k2), pa.array(np.diff(at)), lists], names=["doc_id", "t", "k1", "k2", "units", "bands"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text"), kernel, "doc_id long, t long, k1 long, k2 long, units long, bands array<long>")


def _cells_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(nid, cells) of the wanted nodes (columns nid, rep, k1, k2), from one row of each."""

    def kernel(b):
        for part, data, offs in text_chunks(b):
            cells, _, at = _units(data, offs)
            k1, k2 = content_keys(cells, at)
            own = np.flatnonzero((k1 == np.asarray(part.column(2))) & (k2 == np.asarray(part.column(3))))
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(own)), pa.array([cells[at[i] : at[i + 1]].tobytes() for i in own], pa.binary())], names=["nid", "cells"])

    hit = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(wanted, F.col("rep").eqNullSafe(wanted["rep_id"])).select("nid", "text", "k1", "k2")
    return map_arrow(hit, kernel, "nid long, cells binary")


def _links(pairs: DataFrame, cells: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose exact likeness reaches the threshold."""

    def kernel(b):
        a_, b_ = b.column(2).to_pylist(), b.column(3).to_pylist()
        fine = [weighted_jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= threshold for x, y in zip(a_, b_, strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(fine)), b.column(1).filter(pa.array(fine))], names=["a", "b"])

    two = pairs.join(cells.select(F.col("nid").alias("b"), F.col("cells").alias("cb")), "b").join(cells.select(F.col("nid").alias("a"), F.col("cells").alias("ca")), "a")
    return map_arrow(two.select("a", "b", "ca", "cb"), kernel, "a long, b long")


def _prefixes(loose: DataFrame, threshold: float) -> DataFrame:
    """(token, pos, nid, n): the rarest units of each node, enough that two nodes of the threshold share one.

    Nodes of n units with likeness t share t * n of them or more, so of the n - ceil(t * n) + 1 first units
    in any common order at least one. The order is by how often a unit's slot occurs in a fixed table of
    ``SLOTS`` counts (rare first), so passages that many texts share come last.
    """
    spark = loose.sparkSession

    def count(b):
        for i in range(0, b.num_rows, 256):
            cells = np.frombuffer(b"".join(b.column(0).slice(i, 256).to_pylist()), np.uint64)
            slot, n = np.unique(mix(cells) % np.uint64(SLOTS), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(n.astype(np.int64))], names=["slot", "n"])

    counts = map_arrow(loose.select("cells"), count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # SLOTS rows at most
    often = np.zeros(SLOTS, np.int64)
    often[counts.column("slot").to_numpy()] = counts.column("n").to_numpy()
    del counts
    shared = spark.sparkContext.broadcast(often)

    def first(b):
        for i in range(b.num_rows):
            c = np.frombuffer(b.column(1)[i].as_py(), np.uint64)
            take = len(c) - math.ceil(threshold * len(c) - 1e-9) + 1
            p = c[np.lexsort((c, shared.value[(mix(c) % np.uint64(SLOTS)).astype(np.int64)]))[:take]]
            yield pa.RecordBatch.from_arrays([pa.array(p.view(np.int64)), pa.array(np.arange(len(p))), pa.array(np.full(len(p), b.column(0)[i].as_py())), pa.array(np.full(len(p), len(c)))], names=["token", "pos", "nid", "n"])

    return map_arrow(loose.select("nid", "cells"), first, "token long, pos long, nid long, n long")


def _reach(n: str, pos: str, n2: str, pos2: str, threshold: float):
    """Whether two nodes whose first shared unit is at these places can share enough: only what follows can be shared."""
    need = F.ceil((F.col(n) + F.col(n2)) * (threshold / (1 + threshold)) - 1e-9)
    return (F.least(n, n2) >= threshold * F.greatest(n, n2) - 1e-9) & (F.col(n) - F.col(pos) >= need) & (F.col(n2) - F.col(pos2) >= need)


def _classes(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, t, class_id, comp) of every row with words, and (doc_id, t) of the others."""
    tmp = Scratch(docs.sparkSession, "minhash")
    signed = tmp.table(sign(docs), "signed")
    some = signed.filter("units > 0")
    nodes = tmp.table(some.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")).withColumn("nid", F.monotonically_increasing_id()), "nodes")
    keys = nodes.select("nid", F.explode("bands").alias("h"))
    shared = keys.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    members = tmp.table(keys.join(shared, "h").select("h", "nid", "n"), "members")
    # the node that meets most others stands in the middle of its group: every node is first compared with the most central one it meets
    weight = members.groupBy("nid").agg(F.sum("n").alias("w"))
    hubs = members.join(weight, "nid").groupBy("h").agg(F.max(F.struct("w", (-F.col("nid")).alias("neg"))).alias("top"))
    best = members.join(hubs, "h").groupBy("nid").agg(F.max("top").alias("top"))
    first = tmp.table(best.select((-F.col("top.neg")).alias("hub"), "nid").filter("hub <> nid").select(F.least("hub", "nid").alias("a"), F.greatest("hub", "nid").alias("b")).distinct(), "pairs0")
    wanted = weight.join(nodes, "nid").select("nid", F.col("rep").alias("rep_id"), "k1", "k2")
    cells = tmp.table(_cells_of(docs, wanted), "cells")
    if cells.groupBy("nid").count().filter("count > 1").limit(1).count():  # only where rows are repeated
        cells = tmp.table(cells.dropDuplicates(["nid"]), "cells_once")
    links = tmp.table(_links(first, cells, threshold), "links0")
    comps = connected_components(links, tmp, "cc0")
    # buckets that still hold several components: their nodes are compared wherever a link could join two of them
    named = members.join(comps.withColumnRenamed("node", "nid"), "nid", "left").select("h", "nid", F.coalesce("comp", "nid").alias("comp"))
    mixed = named.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("h")
    loose = tmp.table(named.join(mixed, "h", "left_semi").select("nid").distinct().join(cells, "nid"), "loose")
    every = tmp.table(_prefixes(loose, threshold), "every_token")
    met = every.join(every.groupBy("token").agg(F.count("*").alias("m")).filter("m > 1"), "token")
    tokens = tmp.table(met.join(met.groupBy("nid").agg(F.sum("m").alias("w")), "nid").select("token", "pos", "nid", "n", "w"), "tokens")
    tried = first
    for step in range(1, ROUNDS + 2):
        here = tokens.join(comps.withColumnRenamed("node", "nid"), "nid", "left").select("token", "pos", "nid", "n", "w", F.coalesce("comp", "nid").alias("comp"))
        split = here.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(F.struct("w", (-F.col("nid")).alias("neg"), "comp", "n", "pos")).alias("top")).filter("lo <> hi").select("token", "top")
        if step <= ROUNDS:  # once more each with a central node, of another component: one comparison per node
            met = here.join(split, "token").filter((F.col("comp") != F.col("top.comp")) & _reach("n", "pos", "top.n", "top.pos", threshold))
            hub = -F.col("top.neg")
            cand = met.select(F.least(hub, "nid").alias("a"), F.greatest(hub, "nid").alias("b"), "nid", F.col("top.w").alias("w")).distinct().join(tried, ["a", "b"], "left_anti")
            pairs = cand.groupBy("nid").agg(F.max(F.struct("w", "a", "b")).alias("p")).select("p.a", "p.b").distinct()
        else:  # and at last all that are left
            sizes = here.groupBy("token", "comp").agg(F.count("*").alias("c"))
            big = sizes.groupBy("token").agg(F.max_by("comp", F.struct("c", "comp")).alias("big"), F.count("*").alias("comps")).filter("comps > 1").select("token", "big")
            rest = here.join(big, "token")
            other = rest.select("token", F.col("nid").alias("nid2"), F.col("comp").alias("comp2"), F.col("n").alias("n2"), F.col("pos").alias("pos2"))
            met = rest.filter("comp <> big").join(other, "token").filter((F.col("comp") != F.col("comp2")) & _reach("n", "pos", "n2", "pos2", threshold))
            pairs = met.select(F.least("nid", "nid2").alias("a"), F.greatest("nid", "nid2").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
        pairs = tmp.table(pairs, f"pairs{step}")
        found = tmp.table(_links(pairs, cells, threshold), f"links{step}")
        tried = tried.unionByName(pairs)
        if found.limit(1).count():
            links = links.unionByName(found)
            comps = connected_components(links, tmp, f"cc{step}")
    used = ["members", "cells", "cells_once", "loose", "every_token", "tokens", *(f"{x}{i}" for x in ("pairs", "links") for i in range(ROUNDS + 2))]
    for name in used:  # what follows reads the signatures, the nodes and the components only
        tmp.drop(name)
    comp = F.coalesce("comp", "nid")
    placed = nodes.select("nid", "k1", "k2", "rep").join(comps.withColumnRenamed("node", "nid"), "nid", "left").withColumn("comp", comp)
    names = placed.groupBy("comp").agg(F.min("rep").alias("class_id"))
    placed = placed.join(names, "comp").select("k1", "k2", "class_id", "comp")
    classed = some.select("doc_id", "t", "k1", "k2").join(placed, ["k1", "k2"]).select("doc_id", "t", "class_id", "comp")
    return classed, signed.filter("units = 0").select("doc_id", "t")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, class_size) of every row."""
    classed, alone = _classes(docs, threshold)
    counts = classed.groupBy("comp").agg(F.count("*").alias("class_size"))
    single = alone.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return classed.join(counts, "comp").select("doc_id", "class_id", "class_size").unionByName(single)


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pipeline stage: of each class the row with the smallest id stays (null before all, then by the text's hash), of a repeated row one.

    Rows are told apart by id and text, so texts that share an id are judged each by itself.
    """
    tmp = Scratch(docs.sparkSession, "keep_one")
    classed, _ = _classes(docs, threshold)
    rows = classed.select("comp", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k"), "t")
    first = rows.groupBy("comp").agg(F.min(F.struct("k", "t")).alias("first"))
    k, t = free_names(docs, "k", "t")
    others = rows.join(first, "comp").filter(F.struct("k", "t") != F.col("first"))
    gone = tmp.table(others.select(F.col("k").alias(k), F.col("t").alias(t)).distinct(), "gone")
    keyed = docs.withColumn(k, F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))).withColumn(t, F.xxhash64("text"))
    kept = keyed.join(gone, [k, t], "left_anti")
    if keyed.groupBy(k, t).count().filter("count > 1").limit(1).count():
        worded = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")  # texts without words are no copies
        kept = kept.filter(worded).dropDuplicates([k, t]).unionByName(kept.filter(~worded))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
