"""Voice conversion, predicted stereo and sample digests against plain loops, and in any split."""

import hashlib
import random

import numpy as np
import pandas as pd
import pytest

from sonaril.operators import allpass
from sonaril.streaming import stateful


def low16(b):
    return ((b + 32768) & 65535) - 32768


def plain_double(x):
    s, out = [0] * 6, []
    clip = lambda v: max(-32768, min(32767, ((v >> 9) + 1) >> 1))
    for v in x:
        for o, (a, b, c) in ((0, allpass.SECTIONS[0]), (3, allpass.SECTIONS[1])):
            y = v << 10
            for k, q in enumerate((a, b, c)):
                d = y - s[o + k]
                t = (d * low16(q)) >> 16
                t += d if k == 2 else 0
                y, s[o + k] = s[o + k] + t, y + t
            out.append(clip(y))
    return out


def plain_raise(x, rate, frame):
    """Frame by frame: a first batch of 1 ms, then of 10 ms."""
    k, step = rate // 1000, allpass.step_of(rate)
    x = [0] * allpass.DELAYS[rate] + x
    up = [0] * 8 + plain_double(x)
    out, at = [], 0
    while at < len(x):
        inner = at % frame
        size = min(k if inner == 0 else 10 * k, frame - inner, len(x) - at)
        i = 0
        while i < size << 17:
            part = (i & 65535) * 12 >> 16
            taps = allpass.TAPS[part] + allpass.TAPS[11 - part][::-1]
            total = sum(t * up[2 * at + (i >> 16) + j] for j, t in enumerate(taps))
            out.append(max(-32768, min(32767, ((total >> 14) + 1) >> 1)))
            i += step
        at += size
    return out


def frames(spark, values):
    return spark.createDataFrame(pd.concat([pd.DataFrame({"stream_id": k, "n": np.arange(len(v)), "s": v}) for k, v in values.items()]).sample(frac=1, random_state=2), "stream_id string, n long, s int")


@pytest.mark.parametrize("rate", [8000, 12000, 16000])
def test_voice(spark, rate):
    rng = random.Random(rate)
    x = {"long": [rng.randrange(-32768, 32768) for _ in range(1500)], "a": [5], "b": [32767] * 333}
    df = frames(spark, x)
    up = allpass.double_rate(df, piece=97).toPandas()
    got = allpass.raise_rate(df, rate, piece=101).toPandas()
    frame = rate // 50
    for k, v in x.items():
        assert up[up.stream_id == k].sort_values("n").s.tolist() == plain_double(v)
        want = plain_raise(v, rate, frame)
        assert got[got.stream_id == k].sort_values("n").s.tolist() == want
        st, parts, at = allpass.Raiser(rate, frame), [], 0
        while at < len(v):  # any split, the state put down and taken up in between
            n = rng.randrange(1, 70)
            st = allpass.Raiser(rate, frame).resume(st.state())
            parts += st.push(v[at : at + n], at + n >= len(v)).tolist()
            at += n
        assert parts == want
    assert len(plain_raise(x["long"][: 4 * frame], rate, frame)) >= 4 * 960


def test_a_stream_is_one_walk_however_its_pieces_lie(spark):
    """Only small sides are broadcast, once their size is known, and partitions are not merged: pieces of a stream leave their grouping in several tasks."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "8k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        rng = random.Random(3)
        x = {k: [rng.randrange(-32768, 32768) for _ in range(900)] for k in "abc"}
        df = frames(spark, x)
        up = allpass.double_rate(df, piece=32).toPandas()
        got = allpass.raise_rate(df, 8000, piece=32).toPandas()
    finally:
        for k in conf:
            spark.conf.unset(k)
    for k, v in x.items():
        at = up[up.stream_id == k].sort_values("n")
        assert at.n.tolist() == list(range(2 * len(v)))
        assert at.s.tolist() == plain_double(v)
        assert got[got.stream_id == k].sort_values("n").s.tolist() == plain_raise(v, 8000, 160)


def test_a_lost_piece_fails(monkeypatch):
    monkeypatch.setattr(stateful, "WAITING", 3)

    class Held:
        value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, v):
            self.value = v

    f = stateful.Framer(4)
    f.state = Held()
    piece = lambda seqs: [pd.DataFrame({"seq": seqs, "samples": [[1]] * len(seqs), "eos": [False] * len(seqs)})]
    list(f.handleInputRows(("a",), iter(piece([0, 2, 3, 4])), None))
    with pytest.raises(ValueError, match="piece 1 is missing"):
        list(f.handleInputRows(("a",), iter(piece([5])), None))


def test_predicted_stereo(spark):
    rng = random.Random(1)
    n, frame, ramp = 230, 40, 16
    mid, side = ([rng.randrange(-30000, 30000) for _ in range(n)] for _ in range(2))
    weights = [(rng.randrange(-8192, 8192), rng.randrange(-8192, 8192)) for _ in range(6)]
    want = []
    for i in range(n):
        f, k = divmod(i, frame)
        old = weights[f - 1] if f else (0, 0)
        w = [o + (k + 1) * ((((c - o) * (65536 // ramp) >> 15) + 1) >> 1) if k < ramp else c for o, c in zip(old, weights[f], strict=True)]
        m2, m1, s1 = (mid[i - 2] if i > 1 else 0), (mid[i - 1] if i else 0), (side[i - 1] if i else 0)
        t = (s1 << 8) + (((m2 + mid[i] + 2 * m1) << 9) * w[0] >> 16)
        t += (m1 << 11) * w[1] >> 16
        e = max(-32768, min(32767, ((t >> 7) + 1) >> 1))
        want.append((max(-32768, min(32767, m1 + e)), max(-32768, min(32767, m1 - e))))
    df = spark.createDataFrame([("a", i, mid[i], side[i]) for i in range(n)], "stream_id string, n long, mid int, side int").repartition(3)
    p = spark.createDataFrame([("a", f, *w) for f, w in enumerate(weights)], "stream_id string, frame long, p0 int, p1 int")
    got = allpass.unmix_predicted(df, p, frame, ramp, block=32).toPandas().sort_values("n")
    assert list(zip(got.l, got.r, strict=True)) == want


@pytest.mark.parametrize("depth,width", [(8, 1), (12, 2), (16, 2), (20, 3), (24, 3), (32, 4)])
def test_sample_digests(spark, depth, width):
    rng = random.Random(depth)
    rows = {k: [[rng.randrange(-(1 << depth - 1), 1 << depth - 1) for _ in range(c)] for _ in range(n)] for k, n, c in (("a", 300, 2), ("b", 1, 1), ("c", 65, 6))}
    df = spark.createDataFrame([(k, n, c, v) for k, x in rows.items() for n, vs in enumerate(x) for c, v in enumerate(vs)], "stream_id string, n long, ch int, s long").repartition(4)
    got = {r.stream_id: (r.n_bytes, r.md5) for r in allpass.sample_digest(df, depth, block=64).collect()}
    for k, x in rows.items():
        body = b"".join(v.to_bytes(width, "little", signed=True) for vs in x for v in vs)
        assert got[k] == (len(body), hashlib.md5(body).hexdigest())
