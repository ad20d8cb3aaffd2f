"""Removal of long strings that occur more than once, by sharded suffix arrays.

A text is a sequence of symbols: its bytes (``BYTES``) or its words (``WORDS``). A symbol goes when a
string of ``length`` symbols covers it that also starts anywhere else. Positions that can match are
brought together first: each start has a canonical anchor, the gram with the smallest hash within its
string, so equal strings have equal anchors at equal offsets. Starts that share an anchor form a run;
a run's text (its starts plus ``length`` - 1 symbols) is a piece. Pieces whose anchor occurs once can't
match. The others go, by anchor, to shards; equal pieces are sent as one with the fact that they are
several (then all their starts repeat), so copies never pile up. A shard builds the suffix array of its
pieces by Larsson-Sadakane refinement (only unsorted groups are sorted again, with tripled depth), takes
the common prefixes of neighbours by Kasai's rule (a suffix whose left context matches that of its
neighbour has one less than the suffix before it, so only the others are compared), and marks starts
with ``length`` or more.

An anchor with more than ``HOT`` pieces is split over several shards by the pieces' hashes. Their
distinct strings are then merged across shards by binary search over sorted 128-bit hashes.

Edges: null text is the empty text; shorter texts lose nothing; repeated rows are documents of their
own (each repeats the other), handled as one entry of which there are several; null ids are kept as
they are; an empty table gives no rows. A shard needs some 80 bytes of arrays for a byte of its texts,
and a very long text's pieces go to as many shards as its anchors do.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonaril.llm.common import Scratch, free_names, map_arrow, mix, prefix_hash, shuffle_partitions, span_hash, text_chunks, tidied, words

HOT = 400
BUNDLE = 1 << 18
SENT = 200_000
PARTS = 16
_C = np.uint64(0x94D049BB133111EB)


class Unit(NamedTuple):
    """What a symbol is, how many make a string that may not repeat, and how many an anchor has."""

    name: str
    length: int
    gram: int

    @property
    def dtype(self):
        return np.dtype(np.uint8 if self.name == "byte" else np.uint64)

    def symbols(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of the texts, the texts' offsets into them, and each symbol's first and last-plus-one byte."""
        if self.name == "byte":
            at = np.arange(len(data) + 1)
            return data, offs, at[:-1], at[1:]
        start, end, doc = words(data, offs)
        return span_hash(prefix_hash(data), start, end), np.searchsorted(doc, np.arange(len(offs))), start, end


BYTES, WORDS = Unit("byte", 400, 64), Unit("word", 51, 8)


# --------------------------------------------------------------------------- anchors and runs
def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every window of w values, from running minima within blocks, forwards and backwards."""
    n = len(v)
    pad = -n % w
    b = np.concatenate((v, np.full(pad, np.iinfo(v.dtype).max, v.dtype))).reshape(-1, w)
    fwd = np.minimum.accumulate(b, axis=1).ravel()
    bwd = np.minimum.accumulate(b[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(bwd[: n - w + 1], fwd[w - 1 : n])


def runs(sym: np.ndarray, offs: np.ndarray, unit: Unit = BYTES):
    """Runs of starts with one anchor: text, first start within it, number of starts, anchor hash."""
    none = np.zeros(0, np.int64)
    length, gram = unit.length, min(unit.gram, max(unit.length // 2, 1))
    n = len(sym) - length + 1
    if n < 1:
        return none, none, none, np.zeros(0, np.uint64)
    s = prefix_hash(sym)
    at = np.arange(len(sym) - gram + 1)
    h = span_hash(s, at, at + gram)
    mask = (np.uint64(1) << np.uint64(max(24, int(len(h)).bit_length()))) - np.uint64(1)
    best = (sliding_min((h & ~mask) | at.astype(np.uint64), length - gram + 1) & mask).astype(np.int64)
    new = np.concatenate(([True], best[1:] != best[:-1]))
    new[offs[:-1][offs[:-1] < n]] = True
    first = np.flatnonzero(new)
    doc = np.searchsorted(offs, first, side="right") - 1
    count = np.minimum(np.append(first[1:], n), offs[doc + 1] - length + 1) - first
    some = count > 0  # strings that reach into the next text aren't any
    first, doc = first[some], doc[some]
    return doc, first - offs[doc], count[some], h[best[first]]


# --------------------------------------------------------------------------- suffix arrays
class Bundle:
    """Pieces laid end to end, each closed by a sentinel that is smaller than any symbol and smaller than later ones."""

    def __init__(self, pieces: list[bytes], dtype: np.dtype = BYTES.dtype):
        sizes = np.array([len(p) for p in pieces], np.int64) // dtype.itemsize
        self.first = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
        gap = bytes(dtype.itemsize)
        self.text = np.frombuffer(gap.join(pieces) + gap, dtype)
        if dtype.itemsize > 1:
            self.text = np.unique(self.text, return_inverse=True)[1]
        #: symbols of so many bits, as many of them as a key has room for
        self.bits = 8 if dtype.itemsize == 1 else max(1, int(self.text.max()).bit_length())
        self.per = 56 // self.bits
        n = len(self.text)
        ends = self.first + sizes
        self.left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)  # symbols before the sentinel
        key = np.zeros(n, np.uint64)
        padded = np.concatenate((self.text, np.zeros(self.per, self.text.dtype))).astype(np.uint64)
        for j in range(self.per):
            key = (key << np.uint64(self.bits)) | np.where(self.left > j, padded[j : j + n], np.uint64(0))
        self.key = (key << np.uint64(8)) | np.minimum(self.left, self.per).astype(np.uint64)

    def suffix_array(self) -> np.ndarray:
        n = len(self.text)
        sa = np.argsort(self.key)
        k = self.key[sa]
        head = np.concatenate(([True], k[1:] != k[:-1]))
        group = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        short = self.left[sa] < self.per  # those end within the key: equal ones are in the order of their sentinels
        at = np.flatnonzero(short)
        sa[at] = sa[at][np.lexsort((sa[at], group[at]))]
        group[at] = at
        rank = np.empty(n, np.int64)
        rank[sa] = group
        size = np.bincount(group, minlength=n)
        todo = np.flatnonzero(size[group] > 1)
        depth, wide = self.per, n < 1 << 21
        while len(todo):
            pos = sa[todo]
            if wide:  # three ranks in one key: the depth triples
                pair = (rank[pos] << 42) | (rank[pos + depth] << 21) | rank[np.minimum(pos + 2 * depth, n - 1)]
            else:
                pair = rank[pos] * n + rank[pos + depth]
            order = np.argsort(pair)
            pos, pair = pos[order], pair[order]
            sa[todo] = pos
            head = np.concatenate(([True], pair[1:] != pair[:-1]))
            idx = np.flatnonzero(head)
            rank[pos] = todo[idx][np.cumsum(head) - 1]
            count = np.diff(np.append(idx, len(todo)))
            todo = todo[np.repeat(count > 1, count)]
            depth *= 3 if wide else 2
        return sa

    def common_prefixes(self, sa: np.ndarray) -> np.ndarray:
        """Length of the common prefix of each suffix with the one before it in ``sa``."""
        n, per = len(sa), self.per
        before = np.full(n, -1, np.int64)
        before[sa[1:]] = sa[:-1]
        i = np.arange(n)
        same = (i > 0) & (before > 0)
        same[same] = (self.text[i[same] - 1] == self.text[before[same] - 1]) & (self.left[i[same] - 1] > 0) & (self.left[before[same] - 1] > 0)
        lcp = np.zeros(n, np.int64)
        a = np.flatnonzero(~same & (before >= 0))
        x, y, own = a.copy(), before[a], a
        while len(x):
            kx, ky = self.key[x], self.key[y]
            full = (kx == ky) & (self.left[x] >= per)
            if not full.all():
                diff = (kx ^ ky)[~full] >> np.uint64(8)
                equal = sum((diff < np.uint64(1 << self.bits * j)).astype(np.int64) for j in range(per))
                lcp[own[~full]] += np.minimum(equal, np.minimum(self.left[x[~full]], self.left[y[~full]]))
            own = own[full]
            lcp[own] += per
            x, y = x[full] + per, y[full] + per
        last = np.maximum.accumulate(np.where(same, 0, i))
        return (lcp[last] - (i - last))[sa]


def repeated_starts(pieces: list[bytes], unit: Unit = BYTES) -> tuple[Bundle, np.ndarray, np.ndarray, np.ndarray]:
    """The bundle, its suffix array, the class of equal strings of each entry, and which positions repeat."""
    b = Bundle(pieces, unit.dtype)
    sa = b.suffix_array()
    near = b.common_prefixes(sa) >= unit.length
    marked = np.zeros(len(sa), bool)
    marked[sa[near]] = True
    marked[sa[:-1][near[1:]]] = True
    return b, sa, np.cumsum(~near), marked


# --------------------------------------------------------------------------- jobs
def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id"), text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("k1"), F.xxhash64(text).alias("k2"))


def _find_anchors(rows: DataFrame, unit: Unit) -> DataFrame:
    def kernel(b):
        for part, data, offs in text_chunks(b):
            sym, offs, _, _ = unit.symbols(data, offs)
            doc, _, _, h = runs(sym, offs, unit)
            at = pa.array(doc)
            yield pa.RecordBatch.from_arrays([part.column(1).take(at), part.column(2).take(at), pa.array(h.view(np.int64))], names=["k1", "k2", "anchor"])

    return map_arrow(rows.select("text", "k1", "k2"), kernel, "k1 long, k2 long, anchor long")


def _second(sym: np.ndarray) -> np.ndarray:
    """Prefix sums for a second hash."""
    return prefix_hash(sym ^ sym.dtype.type(0x5A))


def _cut_pieces(found: DataFrame, unit: Unit) -> DataFrame:
    """One row per run with a repeated anchor; a task sends each piece's text once (sent = 1) and that it has it again (2)."""

    def run(batches):
        sent: dict[tuple[int, int], int] = {}
        for b in batches:
            if not b.num_rows:
                continue
            for part, data, offs in text_chunks(b):
                sym, offs, _, _ = unit.symbols(data, offs)
                doc, start, n, h = runs(sym, offs, unit)
                lists = part.column(part.schema.get_field_index("anchors"))
                wanted = [set(x) for x in lists.to_pylist()]
                a = h.view(np.int64)
                use = np.fromiter((x in wanted[d] for d, x in zip(doc.tolist(), a.tolist(), strict=True)), bool, len(a))
                doc, start, n, a = doc[use], start[use], n[use], a[use]
                lo = offs[doc] + start
                hi = lo + n + unit.length - 1
                p1 = span_hash(prefix_hash(sym), lo, hi).view(np.int64)
                p2 = mix(span_hash(_second(sym), lo, hi) ^ _C).view(np.int64)
                bodies, marks = [], []
                for x, y, i, j in zip(p1.tolist(), p2.tolist(), lo.tolist(), hi.tolist(), strict=True):
                    c = sent.get((x, y), 0)
                    bodies.append(sym[i:j].tobytes() if not c else None)
                    marks.append(c + 1 if c < 2 else 0)
                    if c < 2:
                        sent[x, y] = c + 1
                if len(sent) > SENT:  # later copies are sent again; shards drop them
                    sent.clear()
                at = pa.array(doc)
                yield pa.RecordBatch.from_arrays([part.column(1).take(at), part.column(2).take(at), pa.array(start), pa.array(a), pa.array(p1), pa.array(p2), pa.array(marks, pa.int32()), pa.array(bodies, pa.binary())], names=["k1", "k2", "start", "anchor", "p1", "p2", "sent", "body"])

    return found.select("text", "k1", "k2", "anchors").mapInArrow(tidied(run), "k1 long, k2 long, start long, anchor long, p1 long, p2 long, sent int, body binary")


_SHARD = "p1 long, p2 long, spans array<int>, part int, strings binary"
_STRING = np.dtype([("f1", "<i8"), ("f2", "<i8"), ("p1", "<i8"), ("p2", "<i8"), ("off", "<i4"), ("marked", "?")])


def _spans(flags: np.ndarray) -> list[int]:
    """Flattened [from, to) pairs of the runs of true values."""
    d = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.stack((np.flatnonzero(d == 1), np.flatnonzero(d == -1)), 1).ravel().tolist()


class _Piece(NamedTuple):
    p1: int
    p2: int
    body: bytes
    hot: bool
    several: bool


def _shard(batches, unit: Unit, parts: int):
    """Rows sorted by (anchor, salt, p1, p2, sent): bundles of whole anchors, or of whole salts of a hot one."""
    width = unit.dtype.itemsize
    types = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.binary())

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=[f.split()[0] for f in _SHARD.split(", ")])

    def emit(held, out):
        b, sa, cls, marked = repeated_starts([h.body for h in held], unit)
        for i, h in enumerate(held):
            flags = marked[b.first[i] : b.first[i] + len(h.body) // width - unit.length + 1]
            if h.several:
                flags[:] = True
            if flags.any():
                for c, v in zip(out, (h.p1, h.p2, _spans(flags), None, None), strict=True):
                    c.append(v)
        hot = np.array([h.hot for h in held])
        if hot.any():  # each class of equal strings of a hot anchor once, sorted, in packs by hash
            piece = np.searchsorted(b.first, sa, side="right") - 1
            at = np.flatnonzero((b.left[sa] >= unit.length) & hot[piece])
            _, one = np.unique(cls[at], return_index=True)
            at = at[one]
            pos = sa[at]
            sym = np.frombuffer(bytes(width).join([h.body for h in held]) + bytes(width), unit.dtype)
            x = np.zeros(len(pos), _STRING)
            x["f1"] = span_hash(prefix_hash(sym), pos, pos + unit.length).view(np.int64)
            x["f2"] = mix(span_hash(_second(sym), pos, pos + unit.length) ^ _C).view(np.int64)
            x["p1"], x["p2"] = (np.array([h[k] for h in held], np.int64)[piece[at]] for k in (0, 1))
            x["off"], x["marked"] = pos - b.first[piece[at]], marked[pos]
            x.sort(order=("f1", "f2"))
            to = x["f1"] % parts
            for d in np.unique(to):
                for c, v in zip(out, (None, None, None, int(d), x[to == d].tobytes()), strict=True):
                    c.append(v)

    held: list[_Piece] = []  # of whole anchors
    group: list[_Piece] = []  # of the anchor at hand
    out: list[list] = [[] for _ in types]
    size, last = 0, None

    def close():
        nonlocal size, held, group
        if len(group) == 1 and not group[0].hot:  # copies of one piece; within a piece no string repeats, as its starts differ in their distance to the anchor
            p = group.pop()
            if p.several:
                for c, v in zip(out, (p.p1, p.p2, [0, len(p.body) // width - unit.length + 1], None, None), strict=True):
                    c.append(v)
        held += group
        size += sum(len(p.body) for p in group) // width
        group = []
        if size > BUNDLE:
            emit(held, out)
            held, size = [], 0

    for b in batches:
        for anchor, salt, p1, p2, body, hot in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
            if (anchor, salt) != last:
                close()
                last = (anchor, salt)
            if group and group[-1][:2] == (p1, p2):
                group[-1] = group[-1]._replace(several=True)
            else:
                group.append(_Piece(p1, p2, body, hot, False))
        if len(out[0]) > 1000:
            yield batch(out)
            out = [[] for _ in types]
    close()
    if held:
        emit(held, out)
    if out[0]:
        yield batch(out)


def _merge_shards(batches):
    """(p1, p2, off) of the strings of hot anchors that another shard has, too, and that their own didn't mark; rows sorted by part."""

    def hits(packs):
        keys = [np.ascontiguousarray(x[["f1", "f2"]].astype([("f1", ">i8"), ("f2", ">i8")])).view("S16") for x in packs]
        every = np.sort(np.concatenate(keys))
        for x, k in zip(packs, keys, strict=True):
            # binary search of a shard's strings in the merged ones of all
            more = np.searchsorted(every, k, side="right") - np.searchsorted(every, k, side="left") > 1
            hit = x[more & ~x["marked"]]
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(hit[c])) for c in ("p1", "p2", "off")], names=["p1", "p2", "off"])

    packs, last = [], None
    for b in batches:
        for part, strings in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if part != last and packs:
                yield from hits(packs)
                packs = []
            last = part
            packs.append(np.frombuffer(strings, _STRING))
    if packs:
        yield from hits(packs)


def repeated_spans(docs: DataFrame, tmp: Scratch, unit: Unit = BYTES) -> DataFrame:
    """(k1, k2, text, starts array<struct<start, spans>>) of the documents with repeated strings."""
    spark = docs.sparkSession
    p = shuffle_partitions(spark)
    rows = _rows(docs)
    anchors = tmp.table(_find_anchors(rows, unit), f"{unit.name}_anchors")
    # a table of its own, so that the join with it is a plain one, which adaptive execution can split at a hot anchor
    again = tmp.table(anchors.groupBy("anchor").count().filter("count > 1").select("anchor"), f"{unit.name}_again")
    per_doc = anchors.join(again, "anchor").groupBy("k1", "k2").agg(F.collect_set("anchor").alias("anchors"))
    # equal rows are one from here on; that there are several is all that matters of their number
    once = rows.join(per_doc, ["k1", "k2"]).groupBy("k1", "k2").agg(F.first("text").alias("text"), F.first("anchors").alias("anchors"), F.least(F.count("*"), F.lit(2)).cast("int").alias("times"))
    found = tmp.table(once, f"{unit.name}_found")
    for name in ("anchors", "again"):
        tmp.drop(f"{unit.name}_{name}")
    twice = found.select("k1", "k2", "text", "anchors", F.explode(F.sequence(F.lit(1), "times")))
    pieces = tmp.table(_cut_pieces(twice, unit), f"{unit.name}_pieces")
    hot = pieces.filter("sent = 1").groupBy("anchor").count().filter(F.col("count") > HOT).select("anchor", F.ceil(F.col("count") / HOT).alias("salts"))
    bodies = pieces.filter("sent > 0").select("anchor", "p1", "p2", "sent", "body").join(hot, "anchor", "left")
    salted = bodies.select("anchor", F.coalesce(F.pmod(F.xxhash64("p1"), F.col("salts")), F.lit(0)).cast("int").alias("salt"), "p1", "p2", "body", F.col("salts").isNotNull().alias("hot"), "sent")
    sorted_ = salted.repartition(p, "anchor", "salt").sortWithinPartitions("anchor", "salt", "p1", "p2", "sent")
    shards = tmp.table(sorted_.mapInArrow(tidied(lambda it: _shard(it, unit, PARTS * p)), _SHARD), f"{unit.name}_shards")
    packs = shards.filter("part IS NOT NULL").select("part", "strings").repartition(p, "part").sortWithinPartitions("part")
    more = packs.mapInArrow(tidied(_merge_shards), "p1 long, p2 long, off int").groupBy("p1", "p2").agg(F.flatten(F.collect_set(F.array(F.col("off"), F.col("off") + 1))).alias("spans"))
    spans = shards.filter("part IS NULL").select("p1", "p2", "spans").unionByName(more)
    starts = pieces.select("k1", "k2", "start", "p1", "p2").join(spans, ["p1", "p2"]).groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "spans")).alias("starts"))
    return found.select("k1", "k2", "text").join(starts, ["k1", "k2"])


def _marked(starts: pa.Array, offs: np.ndarray, n: int, length: int) -> np.ndarray:
    """Which of all texts' n symbols are under a repeated string; starts: a list of (start, spans) for each text."""
    each = starts.flatten()
    spans = each.field("spans")
    pairs = np.asarray(spans.flatten()).astype(np.int64).reshape(-1, 2)
    count = np.asarray(spans.value_lengths().fill_null(0)) // 2
    doc = np.repeat(np.arange(len(starts)), np.asarray(starts.value_lengths().fill_null(0)))
    at = pairs + np.repeat(np.asarray(each.field("start")) + offs[doc], count)[:, None]
    d = np.bincount(at[:, 0], minlength=n + 1) - np.bincount(at[:, 1] - 1 + length, minlength=n + 1)
    return np.cumsum(d[:n]) > 0


def _cut_texts(hit: DataFrame, unit: Unit) -> DataFrame:
    """(k1, k2, n_removed, n_spans, kept): what stays of each text."""

    def kernel(b):
        for part, data, offs in text_chunks(b):
            sym, at, first, end = unit.symbols(data, offs)
            under = _marked(part.column(3), at, len(sym), unit.length)
            begins = under.copy()
            begins[1:] &= ~under[:-1]
            head = at[:-1][at[:-1] < len(sym)]
            begins[head] = under[head]  # a run ends with its text
            if len(sym) == len(data):
                gone = under
            else:  # from the first byte of a run of words to its last
                ends = under.copy()
                ends[:-1] &= ~under[1:] | begins[1:]
                gone = np.cumsum(np.bincount(first[begins], minlength=len(data) + 1) - np.bincount(end[ends], minlength=len(data) + 1))[:-1] > 0
            kept = np.concatenate(([0], np.cumsum(~gone)))[offs]
            spans = np.concatenate(([0], np.cumsum(begins)))[at]
            bodies = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offs) - 1, [None, pa.py_buffer(kept.astype(np.int64)), pa.py_buffer(data[~gone])])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(offs) - np.diff(kept)), pa.array(np.diff(spans)), bodies.cast(pa.binary())], names=["k1", "k2", "n_removed", "n_spans", "kept"])

    return map_arrow(hit.select("k1", "k2", "text", "starts"), kernel, "k1 long, k2 long, n_removed long, n_spans long, kept binary")


def remove_repeats(docs: DataFrame, unit: Unit = BYTES) -> DataFrame:
    """``docs`` with text without its repeated strings (cut characters go whole), and n_removed bytes (replacing such a column)."""
    tmp = Scratch(docs.sparkSession, "suffix")
    cut = tmp.table(_cut_texts(repeated_spans(docs, tmp, unit), unit), "cut").dropDuplicates(["k1", "k2"])
    k1, k2, kept, removed = free_names(docs, "k1", "k2", "kept", "removed")
    keyed = docs.drop("n_removed").withColumn(k1, F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))).withColumn(k2, F.xxhash64(F.coalesce("text", F.lit(""))))

    def decode(b):
        texts = [x.decode("utf-8", "ignore") for x in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *b.columns[1:]], names=[kept, k1, k2, removed])

    short = map_arrow(cut.select("kept", "k1", "k2", "n_removed"), decode, f"`{kept}` string, `{k1}` long, `{k2}` long, `{removed}` long")
    both = keyed.join(short, [k1, k2], "left").withColumn("text", F.coalesce(kept, "text"))
    return both.select(*[F.col(f"`{c}`") for c in docs.columns if c != "n_removed"], F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"))


def digest(docs: DataFrame, unit: Unit = BYTES, passage: Unit = WORDS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, passage_bytes) of every document.

    The last two: maximal runs under strings of ``passage`` that repeat (51 words: passages of more than 50), and their bytes.
    """
    tmp = Scratch(docs.sparkSession, "suffix")

    def sha(b):
        yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([hashlib.sha256(x).hexdigest() for x in b.column(4).to_pylist()])], names=[*b.schema.names[:4], "sha"])

    cut = map_arrow(_cut_texts(repeated_spans(docs, tmp, unit), unit), sha, "k1 long, k2 long, n_removed long, n_spans long, sha string").dropDuplicates(["k1", "k2"])
    again = _cut_texts(repeated_spans(docs, tmp, passage), passage).select("k1", "k2", F.col("n_spans").alias("n_passages"), F.col("n_removed").alias("passage_bytes")).dropDuplicates(["k1", "k2"])
    base = _rows(docs).select("doc_id", "k1", "k2", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole"))
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_removed", "n_spans", "n_passages", "passage_bytes")]
    both = base.join(cut, ["k1", "k2"], "left").join(again, ["k1", "k2"], "left")
    return both.select("doc_id", "n_bytes", *counts[:2], F.coalesce("sha", "whole").alias("kept_sha256"), *counts[2:])
