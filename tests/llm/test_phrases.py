"""Phrases against plain counting."""

import collections
import random
import re

import numpy as np
import pytest

from sonaril.llm import phrase_tries as pt


def brute(rows, least, inside=80):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = lang or "und"
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            ws = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for m in range(1, 5):
                for i in range(len(ws) - m + 1):
                    f[lang, tuple(ws[i : i + m])] += 1
    cands = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = set()
    for (lang, ws), a in cands.items():
        score, k = min((2000000 * a // (f[lang, ws[:k]] + f[lang, ws[k:]]), k) for k in range(1, len(ws)))
        longer = [b for (g, v), b in cands.items() if g == lang and len(v) > len(ws) and any(v[i : i + len(ws)] == ws for i in range(len(v)))]
        if not any(100 * b >= inside * a for b in longer):
            out.add((lang, " ".join(ws), a, f[lang, ws[:k]], f[lang, ws[k:]], n[lang], score))
    return out


def corpus(rng, n):
    heads = ["the", "of", "Straße", "naïve", "x", "y", "z", "very"]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randrange(40)):
            words += rng.choice([[rng.choice(heads)], ["new", "york", "city"], ["New", "York"], ["a", "b", "c", "d", "e"], ["the", f"w{rng.randrange(30)}"]])
        seps = [" "] * 6 + ["\t ", ", ", ".\n", "! "]
        rows.append((rng.choice(["en", "en", "en", "de", None]), "".join(w + rng.choice(seps) for w in words)))
    return rows + [(None, None), ("en", ""), ("en", "the " * 700), ("fr", "...,\n;"), ("de", "a b"), ("de", "a b")]


def found(docs, least):
    rows = [tuple(r) for r in pt.collocations(docs, least).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("shard,bits", [(1 << 20, 1 << 28), (50, 1 << 28), (200, 1 << 15)])
def test_collocations(spark, monkeypatch, shard, bits):
    """Whatever the shards, and however much the filters let through."""
    monkeypatch.setattr(pt, "SHARD", shard)
    monkeypatch.setattr(pt, "FILTER_BITS", bits)
    rows = corpus(random.Random(shard), 250)
    docs = spark.createDataFrame([(i, lang, t, i) for i, (lang, t) in enumerate(rows)], "doc_id long, lang string, text string, range int").repartition(3)
    assert found(docs, 8) == brute(rows, 8)
    assert pt.collocations(docs.filter("doc_id < 0")).collect() == []


def test_first_of_each_language(spark):
    rows = corpus(random.Random(9), 300)
    docs = spark.createDataFrame(rows, "lang string, text string")
    want = sorted(brute(rows, 30), key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    rank, best = collections.Counter(), []
    for r in want:
        rank[r[0]] += 1
        if rank[r[0]] <= 3:
            best.append((r[0], rank[r[0]], *r[1:]))
    assert sorted(map(tuple, pt.top_collocations(docs, 3).collect())) == sorted(best) and best


def test_words_by_blocks():
    rng = random.Random(2)
    for _ in range(60):
        texts = ["".join(rng.choice(["ab", "C", " ", "\t", ".", "\n", "é"]) for _ in range(rng.randrange(30))).encode() for _ in range(rng.randrange(1, 6))]
        offs = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        data = np.frombuffer(b"".join(texts), np.uint8)
        want = []
        for d, t in enumerate(texts):
            for piece in re.finditer(rb"[^.,;:!?\x0a-\x0d]+", t):
                ws = [m.group().lower() for m in re.finditer(rb"[^\x20\x09]+", piece.group())]
                want += [(w, i > 0, d) for i, w in enumerate(ws)]
        got = []
        for _, follows, start, end, doc in pt.piece_words(data, offs, rng.choice([1, 3, 9, 1000])):
            got += [(bytes(data[a:z]).lower(), bool(f), int(d)) for f, a, z, d in zip(follows, start, end, doc, strict=True)]
        assert got == want


def test_slices_merge_to_the_whole():
    """Any bounds: every phrase is in one range, with its count and those of its left parts."""
    rng = np.random.default_rng(4)
    for trial in range(40):
        shards, want = [], collections.Counter()
        for _ in range(4):
            h = rng.integers(1, 7, 60).astype(np.uint64)
            shards.append(pt.grow(h, np.ones(60, bool), 60, 4, []))
            for m in range(1, 5):
                for i in range(60 - m + 1):
                    want[tuple(h[i : i + m].tolist())] += 1
        bounds = sorted({tuple(rng.integers(1, 8, rng.integers(1, 5)).tolist()) for _ in range(trial % 7)})
        slices = collections.defaultdict(list)
        for levels in shards:
            for r, part, on in pt.cut(levels, bounds):
                slices[r].append((part, on))
        got = {}
        for r, parts in slices.items():
            levels, above = pt.merge(parts)
            path, left = [], []
            for d, (lev, over) in enumerate(zip(levels, above, strict=True)):
                up = lev.parent if d else np.zeros(len(lev.word), np.int64)
                path, left = [*(p[up] for p in path), lev.word], [*(f[up] for f in left), lev.count]
                for i in np.flatnonzero(~over):
                    p = tuple(int(x[i]) for x in path)
                    assert p not in got and sum(b <= p for b in bounds) == r
                    got[p] = [int(x[i]) for x in left]
        assert got == {p: [want[p[: k + 1]] for k in range(len(p))] for p in want}


def test_filters(spark):
    keys = np.random.default_rng(1).integers(0, 1 << 63, 3000, dtype=np.uint64)
    df = spark.createDataFrame([(int(k),) for k in keys], "key long")
    f = pt.filter_of(df, 3000)
    assert f.has(keys << np.uint64(1)).all()
    assert f.has(np.random.default_rng(2).integers(0, 1 << 63, 3000, dtype=np.uint64)).mean() < 0.1
