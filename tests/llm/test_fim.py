"""Fill-in-middle against the rule stated with a regular expression."""

import hashlib
import random
import re

import numpy as np
import pytest

from sonaril.llm import fim_dfa
from sonaril.llm.fim_dfa import Automaton, Spec

UNITS = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")
TEXTS = [None, "", " ", "one", " one two", "one \n", "a <P> b", "a <", "<S", "x<<M>y", "é漢😀 ü", "a\x00b\x1fc d", "<P<P<S<M z"]


def brute(doc_id, text):
    text = text or ""
    units = UNITS.findall(text)
    n = len(units)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form = "spm" if h[3] % 100 < 80 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return n, form, len(p), len(m), sha(out), sha(text)


def noise(rng, n):
    return "".join(rng.choice([" ", "\n", "\t", "a", "é", "漢", "😀", "<", "P", ">", "S", "M", "bcd"]) for _ in range(n))


def test_digest(spark):
    rng = random.Random(3)
    rows = [(i, t, "x") for i, t in enumerate(TEXTS * 3)] + [(100 + i, noise(rng, rng.randrange(60)), None) for i in range(400)]
    rows += [(None, "no id at all", "x"), (None, "no id at all", "x"), (7, "again", "y"), (7, "again", "y"), (9000, noise(rng, 300_000), None), (9001, "word " * 200_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string")
    got = sorted((tuple(r) for r in fim_dfa.digest(docs).collect()), key=repr)
    assert got == sorted(((d, *brute(d, t)) for d, t, _ in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fim_dfa.digest(docs.filter("doc_id = -1")).collect() == []


def test_texts_and_clashing_columns(spark):
    rows = [(i, f"unit {i} of the text", i, "kept") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fim_form int, _text string")
    out = fim_dfa.fill_in_middle(docs)
    assert out.columns == [*docs.columns, "_fim_form", "fim_prefix_chars", "fim_middle_chars"]
    for r in out.collect():
        want = brute(r.doc_id, f"unit {r.doc_id} of the text")
        assert (r["_fim_form"], r.fim_prefix_chars, r.fim_middle_chars, hashlib.sha256(r.text.encode()).hexdigest()) == want[1:5]
        assert (r.fim_form, r["_text"]) == (r.doc_id, "kept")


@pytest.mark.parametrize("lane,block", [(7, 64), (64, 512)])
def test_lanes_see_what_one_run_sees(monkeypatch, lane, block):
    """Whatever the lanes, an emission is that of the automaton run byte by byte."""
    monkeypatch.setattr(fim_dfa, "LANE", lane)
    monkeypatch.setattr(fim_dfa, "BLOCK", block)
    rng = random.Random(5)
    for sentinels in ((b"<P>", b"<S>", b"<M>"), (b"aba", b"ab ab", b"<fim>")):
        a = Automaton(sentinels)
        data = np.frombuffer(b"\xff".join(noise(rng, rng.randrange(90)).replace("bcd", "ab").encode() for _ in range(30)), np.uint8)
        state, want = 0, []
        for c in a.classes[data]:
            want.append(int(a.emit[state + c]))
            state = a.step[state + c]
        assert a.scan(data).tolist() == want


def test_other_sentinels_and_shares(spark):
    spec = Spec(seed=7, rate=100, suffix_first=0, prefix=b"<|pre|>", suffix=b"<|suf|>", middle=b"<|mid|>")
    docs = spark.createDataFrame([(i, f"a{i} b c <P> d\n") for i in range(50)], "doc_id long, text string")
    rows = fim_dfa.digest(docs, spec).collect()
    assert {r.form for r in rows} == {"psm"} and all(r.restored_sha256 == hashlib.sha256(f"a{r.doc_id} b c <P> d\n".encode()).hexdigest() for r in rows)
