"""Phrases whose words come together more often than their parts do, by depth-limited count tries.

Every shard of the corpus (``SHARD`` words) counts its phrases in a trie: level d holds the phrases of d
words as (parent, word, count), sorted by path. Rounds deepen the tries one level at a time: a phrase
that occurs ``least`` times has only parts that do, so a round counts a phrase only where the phrases of
one word less at its start and end are known to (a bitmap of fixed size says so; it may let others
through, which costs time and changes nothing). A shard's trie is cut into prefix ranges and serialised
sorted; a task merges the slices of one range from all shards. A slice brings its ancestors with it, so
that a walk from a phrase up the merged trie meets the whole counts of its left parts; its right parts
are the nodes that its suffix links name, met by a join of the few frequent phrases.

Ranges are drawn so that they are even: split points are a bounded sample (``POINTS`` a range) of the
frequent phrases of the round before, by weight, and a phrase that holds many points is split by its
next word. So one word, or one phrase, may hold most occurrences. Words are 64-bit hashes of language
and letters, with the language's root above them.

Edges: null and empty texts have no words; a null language is ``und``; repeated rows count again; very
long texts are read by blocks and go to as many shards as they fill; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonaril.llm.common import CHUNK_BYTES, Scratch, lower_ascii, mix, prefix_hash, shuffle_partitions, span_hash, text_chunks, tidied

SHARD = 1 << 19
DEPTH = 4
POINTS = 16
#: bits of a filter: 16 for each phrase, and never more than 32 MB, which is what a broadcast of it takes
FILTER_BITS = 1 << 28
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 0x09]] = True


# --------------------------------------------------------------------------- words
def blocks(data: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Bounds of blocks of about ``size`` bytes that end between words."""
    lo, n = 0, len(data)
    while lo < n:
        hi = min(lo + size, n)
        if hi < n:
            gaps = np.flatnonzero(_GAP[data[lo:hi]])
            while not len(gaps) and hi < n:  # a word longer than a block
                gaps, hi = np.flatnonzero(_GAP[data[hi : hi + size]]) + (hi - lo), min(hi + size, n)
            hi = lo + int(gaps[-1]) + 1 if len(gaps) else n
        yield lo, hi
        lo = hi


def piece_words(data: np.ndarray, offs: np.ndarray, size: int = CHUNK_BYTES):
    """By blocks: hash of each lower-cased word, whether it follows the word before in its piece, first byte, end and text."""
    open_ = False  # whether the last word's piece is still open
    for lo, hi in blocks(data, size):
        part = lower_ascii(data[lo:hi])
        edge = np.zeros(len(part) + 1, bool)
        inner = offs[(offs >= lo) & (offs <= hi)] - lo
        edge[inner] = True
        word = ~_GAP[part]
        start = np.flatnonzero(word & (edge[:-1] | np.concatenate(([True], ~word[:-1]))))
        if not len(start):
            open_ = open_ and not _BREAK[part].any() and not edge[:-1].any()
            continue
        end = np.flatnonzero(word & (edge[1:] | np.concatenate((~word[1:], [True])))) + 1
        cuts = np.cumsum(_BREAK[part] | edge[:-1])
        follows = np.concatenate(([open_ and cuts[start[0]] == 0], cuts[start[1:]] == cuts[end[:-1] - 1]))
        open_ = bool(cuts[-1] == cuts[end[-1] - 1])
        h = span_hash(prefix_hash(part), start, end)
        yield h, follows, start + lo, end + lo, np.searchsorted(offs, start + lo, side="right") - 1


def language_hash(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "big") | 1


def step_hash(path: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a path with one more word."""
    return mix(path * np.uint64(0x9FB21C651E98DF25) + word)


# --------------------------------------------------------------------------- filters
class Filter:
    """A bitmap of path hashes."""

    def __init__(self, bits: int, data: np.ndarray):
        self.bits, self.data = bits, data

    def has(self, path: np.ndarray) -> np.ndarray:
        at = (path >> np.uint64(1)) & np.uint64(self.bits - 1)
        return (self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def filter_of(nodes: DataFrame, rows: int) -> Filter:
    """The filter of frequent paths (column ``key``: their hash without its last bit), built by Spark and collected as at most 32 MB of bits."""
    bits = min(FILTER_BITS, max(1 << 15, 1 << (16 * max(rows, 1) - 1).bit_length()))
    at = F.col("key").bitwiseAND(F.lit(bits - 1)) + 1
    parts = nodes.select(at.alias("at")).groupBy(F.call_function("bitmap_bucket_number", "at").alias("b")).agg(F.call_function("bitmap_construct_agg", F.call_function("bitmap_bit_position", "at")).alias("m"))
    data = np.zeros(bits // 8, np.uint8)
    for r in parts.collect():
        data[(r.b - 1) * 4096 : r.b * 4096] = np.frombuffer(r.m, np.uint8)[: bits // 8]
    return Filter(bits, data)


# --------------------------------------------------------------------------- tries
class Level(NamedTuple):
    """Phrases of one length, sorted by path: index of the parent in the level above, last word, count."""

    parent: np.ndarray
    word: np.ndarray
    count: np.ndarray

    def slice(self, lo: int, hi: int, up: int) -> Level:
        return Level((self.parent[lo:hi] - up).astype(np.uint32), self.word[lo:hi], self.count[lo:hi].astype(np.uint32))


def sorted_codes(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and each key's place among them."""
    codes, distinct = pd.factorize(keys)
    order = np.argsort(distinct)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return distinct[order], place[codes]


def grow(h: np.ndarray, follows: np.ndarray, starts: int, depth: int, filters: list[Filter]) -> list[Level]:
    """The trie of phrases of up to ``depth`` words that begin at the first ``starts`` words."""
    words, rank = sorted_codes(h)
    node, path, levels = rank, words, []
    parent, word, place, at = np.zeros(len(words), np.int64), words, rank, np.arange(len(h))
    for d in range(1, depth + 1):
        count = np.bincount(place[: np.searchsorted(at, starts)], minlength=len(word))
        if d <= len(filters):
            keep = filters[d - 1].has(path)
            new = np.where(keep, np.cumsum(keep) - 1, -1)
            parent, word, count, path, place = parent[keep], word[keep], count[keep], path[keep], new[place]
        levels.append(Level(parent, word, count))
        if d == depth:
            break
        node = np.full(len(h), -1, np.int64)
        node[at] = place
        ok = (node[:-1] >= 0) & (node[1:] >= 0)
        if d == 1:
            ok &= follows[1:]
        if len(h) > d:
            ok[len(h) - d :] = False
        at = np.flatnonzero(ok)
        keys, place = sorted_codes(node[at] * len(words) + rank[np.minimum(at + d, len(h) - 1)])
        parent = keys // max(len(words), 1)
        word = words[keys % max(len(words), 1)] if len(keys) else np.zeros(0, np.uint64)
        path = step_hash(path[parent], word)
    return levels


def with_roots(levels: list[Level], roots: dict[int, int]) -> list[Level]:
    """The trie with each language's root among its first words, holding the number of the language's words."""
    word = np.concatenate((levels[0].word, np.array(list(roots), np.uint64)))
    count = np.concatenate((levels[0].count, np.array(list(roots.values()), np.int64)))
    order = np.argsort(word)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    out = [Level(np.zeros(len(word), np.int64), word[order], count[order])]
    if len(levels) > 1:
        out.append(levels[1]._replace(parent=place[levels[1].parent]))
    return out + levels[2:]


def cut(levels: list[Level], bounds: list[tuple[int, ...]]) -> Iterator[tuple[int, list[Level], list[int]]]:
    """(range, its slice, how many first nodes of each level of it are only ancestors) of the ranges that bounds split."""

    def begin(bound: tuple[int, ...] | None) -> list[tuple[int, int]]:
        """First node of each level that isn't before the bound, and whether the one before it lies on the bound's path."""
        out, lo, on = [], 0, True
        for d, lev in enumerate(levels):
            if bound is None:
                out.append((len(lev.word), 0))
                continue
            a = np.searchsorted(lev.parent, lo - 1 if on and d else lo) if d else 0
            if on and d < len(bound):
                z = np.searchsorted(lev.parent, lo) if d else len(lev.word)
                at = a + int(np.searchsorted(lev.word[a:z], np.uint64(bound[d])))
                on = d + 1 < len(bound) and at < z and int(lev.word[at]) == bound[d]
                lo = at + on
            else:
                lo, on = int(a), False
            out.append((lo, int(on)))
        return out

    first = [(0, 0)] * len(levels)
    for r in range(len(bounds) + 1):
        last = begin(bounds[r] if r < len(bounds) else None)
        if any(z > a for (a, _), (z, _) in zip(first, last, strict=True)):
            part, up = [], 0
            for (a, on), (z, _), lev in zip(first, last, levels, strict=True):
                part.append(lev.slice(a - on, z, up))
                up = a - on
            yield r, part, [on for _, on in first]
        elif any(on for _, on in first):  # nothing but ancestors: their counts still belong to the range
            part, up = [], 0
            for (a, on), lev in zip(first, levels, strict=True):
                part.append(lev.slice(a - on, a, up))
                up = a - on
            yield r, part, [on for _, on in first]
        first = last


def merge(parts: list[tuple[list[Level], list[int]]]) -> tuple[list[Level], list[np.ndarray]]:
    """One trie of many, level by level, and which of its nodes are only ancestors."""
    out, flags, where = [], [], [np.zeros(1, np.int64)] * len(parts)
    for d in range(len(parts[0][0])):
        up = np.concatenate([w[levels[d].parent.astype(np.int64)] if d else np.zeros(len(levels[d].word), np.int64) for w, (levels, _) in zip(where, parts, strict=True)])
        words, rank = sorted_codes(np.concatenate([levels[d].word for levels, _ in parts]))
        keys, place = sorted_codes(up * max(len(words), 1) + rank)
        count = np.bincount(place, weights=np.concatenate([levels[d].count for levels, _ in parts]), minlength=len(keys)).astype(np.int64)
        out.append(Level(keys // max(len(words), 1), words[keys % max(len(words), 1)] if len(keys) else np.zeros(0, np.uint64), count))
        sizes = np.cumsum([0, *(len(levels[d].word) for levels, _ in parts)])
        where = [place[a:z] for a, z in zip(sizes[:-1], sizes[1:], strict=True)]
        above = np.zeros(len(keys), bool)
        for w, (_, on) in zip(where, parts, strict=True):
            above[w[: on[d]]] = True
        flags.append(above)
    return out, flags


# --------------------------------------------------------------------------- jobs
_NODE = "depth int, h1 long, h2 long, h3 long, h4 long, key long, a long, f1 long, f2 long, f3 long, lang string, word string"
_NAMES = [f.split()[0] for f in _NODE.split(", ")]
_PATH = ["h1", "h2", "h3", "h4"]


def _shards(docs: DataFrame, depth: int, filters, bounds: list[tuple[int, ...]], last: bool) -> DataFrame:
    """(range, blob): every shard's trie, cut into ranges; those of the last round hold words' letters."""

    def run(batches):
        kept = filters.value
        held: list[tuple[np.ndarray, np.ndarray]] = []
        names: dict[int, tuple[str, bytes | None]] = {}
        roots: dict[int, int] = {}
        size = 0

        def close():
            nonlocal held, size, names, roots
            h, follows = (np.concatenate(x) for x in zip(*held, strict=True))
            rows = []
            for a in range(0, len(h), SHARD):
                z = min(a + SHARD + depth - 1, len(h))
                levels = grow(h[a:z], follows[a:z], min(SHARD, len(h) - a), depth, kept)
                if last and not a:
                    levels = with_roots(levels, roots)
                for r, part, on in cut(levels, bounds):
                    own = [names[x] for x in part[0].word.tolist()] if last else None
                    rows.append((r, pickle.dumps((part, on, own), 5)))
            held, size, names, roots = [], 0, {}, {}
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["range", "blob"])

        for batch in batches:
            if not batch.num_rows:
                continue
            for part, data, offs in text_chunks(batch):
                langs = [x if x is not None else "und" for x in part.column(1).to_pylist()]
                code = {x: language_hash(x) for x in set(langs)}
                of = np.array([code[x] for x in langs], np.uint64)
                for h, follows, start, end, doc in piece_words(data, offs):
                    h = mix(h ^ of[doc]) | np.uint64(1)
                    if last:
                        for lang, n in zip(*np.unique(of[doc], return_counts=True), strict=True):
                            roots[int(lang)] = roots.get(int(lang), 0) + int(n)
                        for x, c in code.items():
                            names[c] = (x, None)
                        distinct, one = np.unique(h, return_index=True)
                        ok = kept[0].has(distinct)
                        for x, i in zip(distinct[ok].tolist(), one[ok].tolist(), strict=True):
                            if x not in names:
                                names[x] = (langs[doc[i]], lower_ascii(data[start[i] : end[i]]).tobytes())
                    held.append((h, follows))
                    size += len(h)
            if size >= SHARD:
                yield from close()
        if held:
            yield from close()

    return docs.select("text", F.col("lang").cast("string").alias("lang")).mapInArrow(tidied(run), "range int, blob binary")


def _merged(batches, depth: int, least: int, last: bool):
    """Frequent nodes of each range: those of the deepest level, or of all with the counts of their left parts."""
    ranges: dict[int, list] = {}
    names: dict[int, tuple[str, bytes | None]] = {}
    for b in batches:
        for r, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            part, on, own = pickle.loads(blob)
            ranges.setdefault(r, []).append((part, on))
            if last:
                names.update(zip(part[0].word.tolist(), own, strict=True))
    for parts in ranges.values():
        levels, above = merge(parts)
        path, left, key = [], [], None
        for d, (lev, over) in enumerate(zip(levels, above, strict=True)):
            up = lev.parent if d else np.zeros(len(lev.word), np.int64)
            path = [*(p[up] for p in path), lev.word]  # the walk: what holds of the parent holds of the child
            left = [*(f[up] for f in left), lev.count]
            key = step_hash(key[up], lev.word) if d else lev.word
            if d < depth - 1 and not last:
                continue
            ok = np.flatnonzero((lev.count >= least) & ~over)
            cols = [p[ok].view(np.int64) for p in path] + [np.zeros(len(ok), np.int64)] * (DEPTH - d - 1)
            counts = [pa.array(left[k][ok]) if k < d else pa.nulls(len(ok), pa.int64()) for k in range(3)]
            own = [names[x] for x in lev.word[ok].tolist()] if last and not d else [(None, None)] * len(ok)
            words = pa.array([w for _, w in own], pa.binary()).cast(pa.string(), safe=False) if not d else pa.nulls(len(ok), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ok), d + 1, np.int32)), *map(pa.array, cols), pa.array((key[ok] >> np.uint64(1)).astype(np.int64)), pa.array(lev.count[ok]), *counts, pa.array([x for x, _ in own], pa.string()), words], names=_NAMES)


def _bounds(nodes: DataFrame | None, depth: int, ranges: int) -> list[tuple[int, ...]]:
    """Ascending paths that split the tries into even ranges: points by weight along the frequent paths of one word less."""
    full = 1 << 64
    if nodes is None:
        return [(full * i // ranges,) for i in range(1, ranges)]
    total = nodes.agg(F.sum("a")).first()[0]
    if not total:
        return []
    want = POINTS * ranges
    path = _PATH[: depth - 1]
    u = (F.xxhash64(*path, F.lit(7)) / F.lit(2.0**64)) + 0.5
    points = nodes.select(*path, F.floor(F.col("a") * (want / total) + u).cast("long").alias("m"), u.alias("u")).filter("m > 0")
    found = []
    for r in points.collect():  # at most about ``want`` rows
        found += [(*(x % full for x in r[: depth - 1]), min(full - 1, int((j + r.u) / r.m * full))) for j in range(r.m)]
    found.sort()
    return sorted({found[len(found) * i // ranges] for i in range(1, ranges)} - {found[0]}) if found else []


def frequent_phrases(docs: DataFrame, tmp: Scratch, least: int, depth: int = DEPTH) -> DataFrame:
    """Nodes (depth, h1..h4, a, counts f1..f3 of the left parts; of depth 1 lang and word, the word of a language's root null) that occur ``least`` times."""
    spark = docs.sparkSession
    p = shuffle_partitions(spark)
    filters: list[Filter] = []
    nodes = None
    for d in range(1, depth + 1):
        last = d == depth
        sent = spark.sparkContext.broadcast(filters)
        shards = _shards(docs, d, sent, _bounds(nodes, d, p), last)
        merged = shards.repartitionById(p, F.col("range")).mapInArrow(tidied(lambda it, d=d, last=last: _merged(it, d, least, last)), _NODE)
        nodes = tmp.table(merged, f"depth{d}")
        if d > 1:
            tmp.drop(f"depth{d - 1}")
        if not last:
            filters = [*filters, filter_of(nodes, nodes.count())]
    return nodes


def _scored(docs: DataFrame, least: int, inside: int) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, a, l, r, score) of the phrases that stay, and (lang, n) of the languages."""
    tmp = Scratch(docs.sparkSession, "phrases")
    nodes = frequent_phrases(docs, tmp, least)
    words = nodes.filter("depth = 1")
    long_ = nodes.filter("depth > 1").select("depth", *_PATH, "a", "f1", "f2", "f3")
    zero = F.lit(0).cast("long")
    at = lambda i: F.col(_PATH[i])

    def path_of(lo: int, size: int):
        return [at(lo + i) if i < size else zero for i in range(DEPTH)]

    # right parts: the node that a suffix link names
    cuts = []
    for m in range(2, DEPTH + 1):
        for k in range(1, m):
            own = F.struct(F.lit(k).alias("k"), F.col(f"f{k}").alias("l"), *[c.alias(f"s{i + 1}") for i, c in enumerate(path_of(k, m - k))])
            cuts.append((m, own))
    per = F.when(F.col("depth") == 2, F.array(*[c for m, c in cuts if m == 2])).when(F.col("depth") == 3, F.array(*[c for m, c in cuts if m == 3])).otherwise(F.array(*[c for m, c in cuts if m == 4]))
    linked = long_.select(*_PATH, "depth", "a", F.explode(per).alias("c")).select(*_PATH, "depth", "a", "c.*")
    right = nodes.select(*[F.col(h).alias(f"s{i + 1}") for i, h in enumerate(_PATH)], F.col("a").alias("r"))
    scored = linked.join(right, ["s1", "s2", "s3", "s4"]).withColumn("score", F.expr("CAST(CAST(a AS DECIMAL(20, 0)) * 2000000 DIV (l + r) AS LONG)"))
    lowest = scored.groupBy(*_PATH, "depth", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))

    # parts of longer phrases, with the highest count of one that holds them
    parts = []
    for m in range(3, DEPTH + 1):
        for size in range(2, m):
            parts += [(m, F.struct(*[c.alias(h) for h, c in zip(_PATH, path_of(lo, size), strict=True)])) for lo in range(m - size + 1)]
    held = F.when(F.col("depth") == 3, F.array(*[c for m, c in parts if m == 3])).otherwise(F.array(*[c for m, c in parts if m == 4]))
    over = long_.filter("depth > 2").select(F.explode(held).alias("p"), "a").groupBy("p.h1", "p.h2", "p.h3", "p.h4").agg(F.max("a").alias("over"))
    free = lowest.join(over, _PATH, "left").filter(f"over IS NULL OR CAST(over AS DECIMAL(20, 0)) * 100 < CAST(a AS DECIMAL(20, 0)) * {int(inside)}")

    # letters
    spell = words.filter("word IS NOT NULL").select("h1", "lang", "word")
    total = words.filter("word IS NULL").select("lang", F.col("a").alias("n"))
    each = free.select(*_PATH, "a", "c", F.posexplode(F.filter(F.array(*_PATH), lambda h: h != 0)).alias("i", "w"))
    spelled = each.join(spell.withColumnRenamed("h1", "w"), "w").groupBy(*_PATH, "a", "c").agg(F.array_sort(F.collect_list(F.struct("i", "word"))).alias("ws"), F.first("lang").alias("lang"))
    return spelled.select("lang", F.concat_ws(" ", F.transform("ws", lambda x: x["word"])).alias("phrase"), "a", "c.l", "c.r", "c.score"), total


def collocations(docs: DataFrame, least: int = 30, inside: int = 80) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of all phrases of 2 to 4 words that occur ``least`` times and aren't ``inside`` percent of a longer one.

    The score is floor(2000000 a / (l + r)) at its lowest cut into a left and a right part.
    """
    rows, total = _scored(docs, least, inside)
    return rows.join(total, "lang").select("lang", "phrase", "a", "l", "r", "n", "score")


def top_collocations(docs: DataFrame, most: int = 2000, least: int = 30, inside: int = 80) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first by score, count, then letters.

    Tasks keep their own first rows of a language before these meet, so a language of any size is no heavy group.
    """
    rows, total = _scored(docs, least, inside)
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
