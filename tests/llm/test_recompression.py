"""Sequences of words that an earlier document has, against plain search."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from sonaril.llm import common, recompression as rc

CUT = re.compile("[^\x20\x09-\x0d]+")


def brute(rows, length):
    """(doc_id, n_words, n_removed, sha) of each row."""
    big = 1 << 63
    words = [CUT.findall(t or "") for _, t in rows]
    keys = [big if d is None else d for d, _ in rows]
    least = {}
    for k, ws in zip(keys, words, strict=True):
        for i in range(len(ws) - length + 1):
            w = tuple(ws[i : i + length])
            least[w] = min(least.get(w, big), k)
    out = []
    for (d, _), k, ws in zip(rows, keys, words, strict=True):
        gone = [False] * len(ws)
        for i in range(len(ws) - length + 1):
            if least[tuple(ws[i : i + length])] < k:
                gone[i : i + length] = [True] * length
        kept = " ".join(w for w, g in zip(ws, gone, strict=True) if not g)
        out.append((d, len(ws), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def prose(rng, n, vocabulary=400):
    return [f"w{min(rng.randrange(1, vocabulary), rng.randrange(1, vocabulary))}" for _ in range(n)]


def corpus(rng, n=60):
    base = [prose(rng, rng.randrange(30, 400)) for _ in range(12)]
    passage, short = prose(rng, 51), prose(rng, 49)
    rows = []
    for i in range(n):
        ws = list(rng.choice(base)) if rng.random() < 0.6 else prose(rng, rng.randrange(300))
        for _ in range(rng.choice([0, 1, 1, 3])):
            at = rng.randrange(len(ws) + 1)
            ws[at : at + rng.randrange(2)] = rng.choice([[f"edit{i}"], ["é", "漢"], passage, short, prose(rng, 5)])
        rows.append((i, rng.choice([" ", "  ", "\n"]).join(ws)))
    rows += [(100, "la " * 400), (101, "la " * 260), (102, "a b " * 300), (103, "b a " * 90), (104, " ".join(prose(rng, 3) * 200)), (105, "la " * 49), (106, "la " * 50)]
    rows += [(None, rows[0][1]), (None, rows[0][1]), (None, "only here " * 60), (None, "only here " * 60), (7, rows[3][1]), (7, rows[3][1]), (200, None), (201, ""), (-5, rows[9][1]), (202, " \n ")]
    return rows


@pytest.mark.parametrize("slice_", [1 << 17, 120])
def test_digest(spark, monkeypatch, slice_):
    monkeypatch.setattr(rc, "SLICE", slice_)
    rows = corpus(random.Random(slice_))
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, names string, n_removed int").repartition(3)
    got = sorted((tuple(r) for r in rc.digest(docs).collect()), key=repr)
    want = sorted(brute(rows, 50), key=repr)
    assert got == want and sum(r[2] > 0 for r in want) > 10
    assert rc.digest(docs.filter("doc_id = -77")).collect() == []


def test_texts_and_clashing_columns(spark):
    rows = corpus(random.Random(8), 30)
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, kept string, n_removed int")
    out = rc.remove_earlier(docs, 12)
    assert out.columns == [*docs.columns, "_n_removed"]
    for r, (d, n, removed, sha) in zip(sorted(out.collect(), key=lambda r: (repr(r.doc_id), hashlib.sha256(" ".join(CUT.findall(r.text or "")).encode()).hexdigest())), sorted(brute(rows, 12), key=lambda x: (repr(x[0]), x[3])), strict=True):
        assert (r.doc_id, r["_n_removed"], hashlib.sha256(" ".join(CUT.findall(r.text or "")).encode()).hexdigest()) == (d, removed, sha)


def test_many_equal_rows(spark):
    text = " ".join(prose(random.Random(3), 300))
    docs = spark.range(3000).selectExpr("CAST(1 AS LONG) AS doc_id", f"'{text}' AS text").union(spark.createDataFrame([(2, text + " more")], "doc_id long, text string"))
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed) for r in rc.digest(docs).collect())
    assert got == {(1, 300, 0): 3000, (2, 301, 300): 1}


@pytest.mark.parametrize("length,vocabulary", [(50, 400), (50, 2), (12, 3), (5, 50)])
def test_equal_windows_have_equal_names(length, vocabulary):
    """Wherever a window stands, it is filed under one name."""
    rng = np.random.default_rng(length + vocabulary)
    names = {}
    for _ in range(60):
        texts = [rng.integers(1, vocabulary, rng.integers(0, 300)) for _ in range(4)]
        texts[2] = np.concatenate((texts[2][:9], texts[0][5:180], texts[1][3:160]))
        edge = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        h = common.mix(np.concatenate(texts).astype(np.uint64))
        seg, start, n, name = rc.filed(h, edge, length)
        assert n.sum() == sum(max(0, len(t) - length + 1) for t in texts)
        for g, s, m, x in zip(seg, start, n, name, strict=True):
            for i in range(s, s + m):
                assert edge[g] <= i and i + length <= edge[g + 1]
                assert names.setdefault(h[i : i + length].tobytes(), x) == x


def test_levels_shrink_and_stay_consistent():
    """A symbol's words and interval in one text are a symbol with that interval in any text that has them."""
    rng = np.random.default_rng(5)
    inner = rng.integers(1, 30, 200)
    seen = []
    for _ in range(2):
        left, right = rng.integers(1, 30, rng.integers(20, 60)), rng.integers(1, 30, 40)
        h = common.mix(np.concatenate((left, inner, right)).astype(np.uint64))
        level = rc.levels(h, np.array([0, len(h)]))
        assert all(len(a.name) > len(b.name) for a, b in zip(level[:-1], level[1:], strict=True))
        o = len(left)
        seen.append([{(int(x), int(a) - o, int(z) - o) for x, a, z in zip(s.name, s.lo, s.hi, strict=True) if a >= o and z <= o + 200} for s in level])
    assert seen[0] == seen[1] and all(seen[0])
