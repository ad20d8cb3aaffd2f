"""Removal of long word sequences that an earlier document has, by recompression.

Rounds rewrite a text's words: first runs of one symbol become a symbol, then pairs of a left symbol and
a right one do (a symbol's hash says which it is, another way in every round). A name is a hash of what
it stands for, so all tasks of a Spark round give the same name to the same run or pair without asking
each other, and equal passages are rewritten alike but for their ends. Which ends is known exactly: a
symbol carries the interval of words that fixed it (its own and those of the neighbours that it was
decided by); inside any other text that has these words it is there again.

Every window of ``length`` words is filed under one symbol whose interval lies inside the window: of the
highest level that has any, the one with the smallest hash, the first on ties. So equal windows are filed
under equal names, whatever surrounds them. Spark rounds follow. The first counts names: those that only
one id has drop out, and with them nearly all text. The second names pieces (windows in a row under one
symbol): equal pieces are equal in all their windows, so their smallest id decides. The third compares
single windows of the different pieces under one name, which lie at the ends of repeats. Names of pieces
and windows have 128 bits. All are grouped minima, added up before the shuffle; nothing is gathered by
name, so one passage may be in any number of documents.

A window's words go where the same words start in a document with a smaller id. Edges: null and short
texts lose nothing; rows of one id don't cut each other, repeated rows get equal results; a null id
counts as the greatest; texts of any length go by slices that overlap; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonaril.llm.common import Scratch, free_names, long_word_hashes, map_arrow, mix, prefix_hash, span_hash, text_chunks

LENGTH = 50
ROUNDS = 4
SLICE = 1 << 17
_RUN, _PAIR, _NEXT = (np.uint64(x) for x in (0x9FB21C651E98DF25, 0xD1342543DE82EF95, 0xAEF17502108EF2D9))


class Symbols(NamedTuple):
    """Symbols of a level in order: name, the interval of words that fixed each, and its segment (a text, or a slice of one)."""

    name: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    seg: np.ndarray


def _around(s: Symbols, at: np.ndarray, step: int, edge: np.ndarray) -> np.ndarray:
    """The bound of the neighbours of symbols ``at``; beyond its segment's words where a segment ends."""
    to = np.clip(at + step, 0, len(s.name) - 1)
    own = (to == at + step) & (s.seg[to] == s.seg[at])
    return np.where(own, (s.lo if step < 0 else s.hi)[to], edge[s.seg[at] + (step > 0)] + step)


def name_runs(s: Symbols, edge: np.ndarray) -> Symbols:
    """Maximal runs of one symbol to a symbol each; a run is fixed by the neighbours that end it."""
    n = len(s.name)
    head = np.concatenate(([True], (s.name[1:] != s.name[:-1]) | (s.seg[1:] != s.seg[:-1])))
    first = np.flatnonzero(head)
    last = np.append(first[1:], n) - 1
    count = (last - first + 1).astype(np.uint64)
    name = s.name[first]
    name = np.where(count > 1, mix(name * _RUN + count), name)
    return Symbols(name, _around(s, first, -1, edge), _around(s, last, 1, edge), s.seg[first])


def name_pairs(s: Symbols, edge: np.ndarray, turn: int) -> Symbols:
    """A left symbol and the right one after it to one symbol; others stay, fixed by the neighbour that isn't their pair."""
    n = len(s.name)
    right = mix(s.name ^ np.uint64(0x2545F4914F6CDD1D * (turn + 1) % (1 << 64))) >> np.uint64(63) == 1
    opens = np.zeros(n, bool)
    opens[:-1] = ~right[:-1] & right[1:] & (s.seg[1:] == s.seg[:-1])
    closes = np.concatenate(([False], opens[:-1]))
    at = np.flatnonzero(~closes)
    two, alone = opens[at], right[at]
    after = np.minimum(at + 1, n - 1)
    name = np.where(two, mix(mix(s.name[at] * _PAIR) + s.name[after] * _NEXT), s.name[at])
    lo = np.where(alone, _around(s, at, -1, edge), s.lo[at])
    hi = np.where(two, s.hi[after], np.where(alone, s.hi[at], _around(s, at, 1, edge)))
    return Symbols(name, lo, hi, s.seg[at])


def levels(h: np.ndarray, edge: np.ndarray, rounds: int = ROUNDS) -> list[Symbols]:
    """The words as symbols, and the symbols after each round; ``edge``: where segments begin, and the end of the last."""
    at = np.arange(len(h))
    out = [Symbols(h, at, at + 1, np.repeat(np.arange(len(edge) - 1), np.diff(edge)))]
    for k in range(rounds):
        out.append(name_pairs(name_runs(out[-1], edge), edge, k))
    return out


def filed(h: np.ndarray, edge: np.ndarray, length: int = LENGTH, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces: segment, first window (within all words), number of windows, and the name they are filed under."""
    seg = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
    start = np.flatnonzero(np.arange(len(h)) + length <= edge[seg + 1])
    name, symbol = np.zeros(len(start), np.uint64), np.full(len(start), -1, np.int64)
    words = prefix_hash(h)
    todo = np.arange(len(start))
    for k, s in reversed(list(enumerate(levels(h, edge, rounds)))):
        if not len(todo):
            break
        a = np.searchsorted(s.lo, start[todo], side="left")
        z = np.searchsorted(s.hi, start[todo] + length, side="right")
        some = z > a
        at, a, z = todo[some], a[some], z[some]
        todo = todo[~some]
        if not len(at):
            continue
        bits = np.uint64(max(1, len(s.name).bit_length()))
        # hash first, place second: the smallest in a range by two overlapping powers of two
        tables = [(mix(s.name ^ _NEXT) >> bits << bits) | np.arange(len(s.name), dtype=np.uint64)]
        power = np.frexp((z - a).astype(np.float64))[1] - 1
        for p in range(int(power.max())):
            t = tables[-1]
            tables.append(np.concatenate((np.minimum(t[: -(1 << p)], t[1 << p :]), t[len(t) - (1 << p) :])))
        table = np.stack(tables)
        best = (np.minimum(table[power, a], table[power, z - (1 << power)]) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        full = mix(span_hash(words, s.lo, np.minimum(s.hi, len(h))) ^ s.name) if len(best) else None  # with the words that fixed it
        name[at], symbol[at] = full[best], best * (rounds + 1) + k
    if not len(start):
        none = np.zeros(0, np.int64)
        return none, none, none, name
    new = np.concatenate(([True], (symbol[1:] != symbol[:-1]) | (start[1:] != start[:-1] + 1)))
    first = np.flatnonzero(new)
    return seg[start[first]], start[first], np.diff(np.append(first, len(start))), name[first]


def groups(offs: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray, int]]:
    """(first word, end, segments' edges, first document) of groups of whole texts, or of a slice of a long one; windows are in one each."""
    d, n = 0, len(offs) - 1
    while d < n:
        if offs[d + 1] - offs[d] > SLICE:
            for lo in range(int(offs[d]), int(offs[d + 1]) - length + 1, SLICE):
                hi = min(lo + SLICE + length - 1, int(offs[d + 1]))
                yield lo, hi, np.array([0, hi - lo]), d
            d += 1
            continue
        e = max(int(np.searchsorted(offs, offs[d] + SLICE, side="right")) - 1, d + 1)
        yield int(offs[d]), int(offs[e]), offs[d : e + 1] - offs[d], d
        d = e


def _pieces(h: np.ndarray, offs: np.ndarray, length: int, keep) -> Iterator[tuple[np.ndarray, ...]]:
    """(document, first word in it, windows, name, two hashes of the words) of the pieces that ``keep`` (documents, names) lets through."""
    for lo, hi, edge, d in groups(offs, length):
        seg, start, n, name = filed(h[lo:hi], edge, length)
        doc = seg + d
        use = keep(doc, name)
        doc, start, n, name = doc[use], start[use], n[use], name[use]
        one, two = _both(h[lo:hi])
        end = start + n + length - 1
        yield doc, start + lo - offs[doc], n, name, span_hash(one, start, end).view(np.int64), span_hash(two, start, end).view(np.int64)


def _both(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return prefix_hash(h), prefix_hash(mix(h ^ _RUN))


# --------------------------------------------------------------------------- jobs
_PIECE = "k1 long, k2 long, start int, n int, name long, p1 long, p2 long"


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("k1"), F.xxhash64(text).alias("k2"))


def _names(rows: DataFrame, length: int) -> DataFrame:
    """(k1, k2, name): what each document's windows are filed under, once each."""

    def kernel(b):
        for part, data, offs in text_chunks(b):
            h, at = long_word_hashes(data, offs)
            docs, names = [], []
            for lo, hi, edge, d in groups(at, length):
                seg, _, _, name = filed(h[lo:hi], edge, length)
                docs.append(seg + d)
                names.append(name)
            if docs:
                both = np.unique(np.rec.fromarrays((np.concatenate(docs), np.concatenate(names)), names="d,n"))
                take = pa.array(both["d"])
                yield pa.RecordBatch.from_arrays([part.column(1).take(take), part.column(2).take(take), pa.array(both["n"].view(np.int64))], names=["k1", "k2", "name"])

    return map_arrow(rows.select("text", "k1", "k2"), kernel, "k1 long, k2 long, name long")


def _flat(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Row number of each value of a list column, and the values."""
    return np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths().fill_null(0))), lists.flatten()


def _name_pieces(found: DataFrame, length: int) -> DataFrame:
    def kernel(b):
        for part, data, offs in text_chunks(b):
            h, at = long_word_hashes(data, offs)
            row, values = _flat(part.column(3))
            salt = lambda d, x: mix(x * _RUN + d.astype(np.uint64))
            wanted = salt(row, np.asarray(values).view(np.uint64))
            keep = lambda d, x, w=wanted: np.isin(salt(d, x), w)
            for doc, start, n, name, p1, p2 in _pieces(h, at, length, keep):
                take = pa.array(doc)
                yield pa.RecordBatch.from_arrays([part.column(1).take(take), part.column(2).take(take), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(name.view(np.int64)), pa.array(p1), pa.array(p2)], names=[f.split()[0] for f in _PIECE.split(", ")])

    return map_arrow(found.select("text", "k1", "k2", "names"), kernel, _PIECE)


def _windows(chosen: DataFrame, length: int) -> DataFrame:
    """(w1, w2, m, p1, p2, off): the windows of chosen pieces of a text; m: the piece's smallest id."""

    def kernel(b):
        for part, data, offs in text_chunks(b):
            h, at = long_word_hashes(data, offs)
            row, values = _flat(part.column(2))
            field = lambda c, v=values: np.asarray(v.field(c)).astype(np.int64)
            n, lo = field("n"), field("start") + at[row]
            which = np.repeat(np.arange(len(n)), n)
            off = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            one, two = _both(h)
            s = lo[which] + off
            cols = [span_hash(x, s, s + length).view(np.int64) for x in (one, two)]
            m = np.asarray(part.column(1)).astype(np.int64)[row][which]
            yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(m), *(pa.array(field(c)[which]) for c in ("p1", "p2")), pa.array(off.astype(np.int32))], names=["w1", "w2", "m", "p1", "p2", "off"])

    return map_arrow(chosen.select("text", "k1", "chosen"), kernel, "w1 long, w2 long, m long, p1 long, p2 long, off int")


def earlier_windows(docs: DataFrame, tmp: Scratch, length: int = LENGTH) -> DataFrame:
    """(k1, k2, text, starts array<struct<start, spans>>) of documents with windows that an earlier one has."""
    rows = _rows(docs)
    names = tmp.table(_names(rows, length), "names")
    shared = tmp.table(names.groupBy("name").agg(F.min("k1").alias("a"), F.max("k1").alias("z")).filter("a < z").select("name"), "shared")
    per_doc = names.join(shared, "name").groupBy("k1", "k2").agg(F.collect_set("name").alias("names"))
    found = tmp.table(rows.join(per_doc, ["k1", "k2"]).dropDuplicates(["k1", "k2"]).select("k1", "k2", "text", "names"), "found")
    for name in ("names", "shared"):
        tmp.drop(name)
    pieces = tmp.table(_name_pieces(found, length), "pieces")
    kinds = tmp.table(pieces.groupBy("name", "p1", "p2").agg(F.min(F.struct("k1", "k2", "start", "n")).alias("first"), F.max("k1").alias("z")), "kinds")
    several = kinds.groupBy("name").agg(F.min("first.k1").alias("a"), F.max("first.k1").alias("b")).filter("a < b").select("name")
    chosen = kinds.join(several, "name").groupBy("first.k1", "first.k2").agg(F.collect_list(F.struct("first.start", "first.n", "p1", "p2")).alias("chosen"))
    windows = tmp.table(_windows(found.select("k1", "k2", "text").join(chosen, ["k1", "k2"]), length), "windows")
    least = windows.groupBy("w1", "w2").agg(F.min("m").alias("a"), F.max("m").alias("b")).filter("a < b").drop("b")
    hits = windows.join(least, ["w1", "w2"]).filter("a < m").groupBy("p1", "p2").agg(F.collect_set("off").alias("offs"))
    # a table of its own, so that the join with it is a plain one, which adaptive execution can split at a piece that very many rows have
    use = tmp.table(kinds.select("p1", "p2", F.col("first.k1").alias("m"), "z").join(hits, ["p1", "p2"], "left").filter("z > m OR offs IS NOT NULL"), "use")
    own = F.transform("offs", lambda o: F.struct(o.alias("a"), (o + 1).alias("z")))
    spans = F.when(F.col("k1") > F.col("m"), F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("z")))).otherwise(own)
    starts = pieces.select("k1", "k2", "start", "n", "p1", "p2").join(use, ["p1", "p2"]).select("k1", "k2", "start", spans.alias("spans")).filter("spans IS NOT NULL").groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "spans")).alias("starts"))
    return found.select("k1", "k2", "text").join(starts, ["k1", "k2"])


def _covered(starts: pa.Array, at: np.ndarray, length: int) -> np.ndarray:
    """Which words are in a window that begins in a span."""
    row, each = _flat(starts)
    inner, spans = _flat(each.field("spans"))
    base = (np.asarray(each.field("start")).astype(np.int64) + at[row])[inner]
    a, z = (np.asarray(spans.field(c)).astype(np.int64) + base for c in ("a", "z"))
    n = int(at[-1])
    return np.cumsum(np.bincount(a, minlength=n + 1)[:n] - np.bincount(z - 1 + length, minlength=n + 1)[:n]) > 0


def kept_words(data: np.ndarray, offs: np.ndarray, first: np.ndarray, end: np.ndarray, at: np.ndarray, keep: np.ndarray) -> list[memoryview]:
    """Of each text the words to keep, joined by one space."""
    n = len(offs) - 1
    pad = np.full(len(data) + n, 32, np.uint8)
    for d in range(n):
        pad[offs[d] + d : offs[d + 1] + d] = data[offs[d] : offs[d + 1]]
    doc = np.repeat(np.arange(n), np.diff(at))
    a, z = (first + doc)[keep], (end + doc)[keep]
    inside = np.zeros(len(pad) + 2, np.int8)
    inside[a] = 1
    inside[z + 1] -= 1  # with the byte after the word
    pad[z] = 32
    mask = np.cumsum(inside[: len(pad)], dtype=np.int8) > 0
    out = memoryview(pad[mask])
    size = np.bincount(doc[keep], weights=(z + 1 - a), minlength=n).astype(np.int64)
    to = np.cumsum(size)
    return [out[t - s : max(t - 1, t - s)] for s, t in zip(size.tolist(), to.tolist(), strict=True)]


def _cut_texts(hit: DataFrame, length: int) -> DataFrame:
    """(k1, k2, n_removed, kept): what stays of each text."""

    def kernel(b):
        for part, data, offs in text_chunks(b):
            h, at, first, end = long_word_hashes(data, offs, bounds=True)
            gone = _covered(part.column(3), at, length)
            kept = kept_words(data, offs, first, end, at, ~gone)
            removed = np.diff(np.concatenate(([0], np.cumsum(gone)))[at])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(removed), pa.array([bytes(x) for x in kept], pa.binary())], names=["k1", "k2", "n_removed", "kept"])

    return map_arrow(hit.select("k1", "k2", "text", "starts"), kernel, "k1 long, k2 long, n_removed long, kept binary")


def remove_earlier(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with texts that lost words as their kept words joined by one space, and the number of lost words (``n_removed``, renamed where taken)."""
    tmp = Scratch(docs.sparkSession, "recompression")
    cut = tmp.table(_cut_texts(earlier_windows(docs, tmp, length), length), "cut")
    k1, k2, kept, removed = free_names(docs, "k1", "k2", "kept", "n_removed")
    keyed = docs.withColumn(k1, F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))).withColumn(k2, F.xxhash64(F.coalesce("text", F.lit(""))))
    short = cut.select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.decode("kept", "utf-8").alias(kept), F.col("n_removed").alias(removed))
    both = keyed.join(short, [k1, k2], "left").withColumn("text", F.coalesce(kept, "text"))
    return both.select(*[F.col(f"`{c}`") for c in docs.columns], F.coalesce(removed, F.lit(0).cast("long")).alias(removed))


def digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document."""
    tmp = Scratch(docs.sparkSession, "recompression")

    def whole(b):
        for part, data, offs in text_chunks(b):
            _, at, first, end = long_word_hashes(data, offs, bounds=True)
            kept = kept_words(data, offs, first, end, at, np.ones(len(first), bool))
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(np.diff(at)), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())], names=["doc_id", "k1", "k2", "n_words", "whole"])

    def sha(b):
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([hashlib.sha256(x).hexdigest() for x in b.column(3).to_pylist()], pa.string())], names=["k1", "k2", "n_removed", "sha"])

    cut = map_arrow(_cut_texts(earlier_windows(docs, tmp, length), length), sha, "k1 long, k2 long, n_removed long, sha string")
    base = map_arrow(_rows(docs).select("text", "doc_id", "k1", "k2"), whole, "doc_id long, k1 long, k2 long, n_words long, whole string")
    both = base.join(cut, ["k1", "k2"], "left")
    return both.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("sha", "whole").alias("kept_sha256"))
