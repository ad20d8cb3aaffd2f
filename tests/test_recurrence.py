"""Recurrences and filters along streams against plain loops."""

import random

import numpy as np
import pandas as pd
import pytest

from sonaril.operators import predict, recurrence


def streams(spark, values: dict, column="x", kind="double"):
    parts = [pd.DataFrame({"stream_id": k, "n": np.arange(len(v)), column: v}) for k, v in values.items() if len(v)]
    return spark.createDataFrame(pd.concat(parts).sample(frac=1, random_state=1), f"stream_id string, n long, {column} {kind}").repartition(3)


def by_stream(df, column):
    return {k: g.sort_values("n")[column].tolist() for k, g in df.toPandas().groupby("stream_id")}


def loop(x, coeffs):
    y = []
    for i, v in enumerate(x):
        y.append(v + sum(c * y[i - j] for j, c in enumerate(coeffs, 1) if i >= j))
    return y


@pytest.mark.parametrize("coeffs,block,group", [([0.85], 16, 3), ([1.6, -0.8], 64, 2), ([3, -3, 1], 10, 4), ([4, -6, 4, -1], 4096, 1024), ([0.1] * 9, 7, 5)])
def test_recurrence_over_blocks_and_groups(spark, coeffs, block, group):
    """One stream holds nearly all rows; others are as short as one sample."""
    rng = random.Random(block)
    whole = all(isinstance(c, int) for c in coeffs)
    draw = lambda n: [rng.randrange(-9, 9) if whole else rng.uniform(-1, 1) for _ in range(n)]
    values = {"long": draw(1500), "a": draw(1), "b": draw(block), "c": draw(block + 1), "d": draw(2)}
    got = by_stream(recurrence.linear_recurrence(streams(spark, values, kind="long" if whole else "double"), coeffs, block=block, group=group), "y")
    for k, x in values.items():
        want = loop(x, coeffs)
        assert got[k] == want if whole else np.allclose(got[k], want, rtol=1e-9, atol=1e-9), k


def test_predictors_in_one_pass(spark):
    rng = random.Random(4)
    x = {"a": [rng.randrange(-30000, 30000) for _ in range(700)], "b": [5], "c": [1, -2, 3]}
    df = streams(spark, x, "s", "int")
    for order in range(5):
        r = predict.fixed_residual(df, order, block=32)
        assert by_stream(predict.fixed_predict(r, order, block=32), "s") == x


def lpc_loop(r, coeffs, shift):
    s = list(r)
    for i in range(len(coeffs), len(r)):
        s[i] += sum(c * s[i - j - 1] for j, c in enumerate(coeffs)) >> shift
    return s


def test_lpc(spark):
    rng = random.Random(7)
    rows = []
    for f in range(150):
        order = rng.choice([0, 1, 2, 8, 32])
        shift = rng.choice([9, 11, 14])
        most = (9 << shift) // (10 * max(order, 1))  # a stable filter
        rows.append((f, [rng.randrange(-50, 50) for _ in range(rng.choice([0, 1, 5, 40, 300]))], [rng.randrange(-most, most) for _ in range(order)], shift))
    df = spark.createDataFrame(rows, "frame long, r array<int>, coeffs array<int>, shift int")
    back = recurrence.lpc_restore(df)
    want = {f: lpc_loop(r, c, s) for f, r, c, s in rows}
    assert {x.frame: list(x.s) for x in back.collect()} == want
    again = back.join(df.select("frame", "coeffs", "shift"), "frame")
    left = again.select("frame", recurrence.lpc_residual(again.s, again.coeffs, again.shift).alias("r"))
    assert {x.frame: list(x.r) for x in left.collect()} == {f: r for f, r, _, _ in rows}


def comb_loop(x, params, size, overlap):
    keep = 1100
    y = [0.0] * keep + [0.0] * len(x)
    for n, v in enumerate(x):
        f, i = divmod(n, size)
        old = params[f - 1] if f else (0, 0.0, 0)
        new = params[f]
        w = 1.0
        if i < overlap and old != new:
            w = np.sin(np.pi / 2 * np.sin(np.pi / 2 * (i + 0.5) / overlap) ** 2) ** 2
        acc = v
        for (p, g, t), part in ((old, 1 - w), (new, w)):
            p = max(p, 15)
            taps = recurrence.COMB_TAPS[t]
            at = lambda d, p=p: y[keep + n - p + d]
            acc += part * g * (taps[0] * at(0) + taps[1] * (at(1) + at(-1)) + taps[2] * (at(2) + at(-2)))
        y[keep + n] = acc
    return y[keep:]


def test_comb_filter(spark):
    """Lags below the least and up to the greatest, loud and silent stretches, which split a stream into chains."""
    rng = random.Random(3)
    size = 100
    frames = {"long": 90, "a": 1, "b": 14}
    params = {k: [(rng.choice([3, 15, 40, 700, 1024]), rng.choice([0.0, 0.3, 0.7]) if k != "long" or f % 45 < 20 or f % 45 == 35 else 0.0, rng.randrange(3)) for f in range(n)] for k, n in frames.items()}
    x = {k: [rng.uniform(-1, 1) for _ in range(n * size - (7 if k == "b" else 0))] for k, n in frames.items()}
    p = spark.createDataFrame([(k, f, *v) for k, ps in params.items() for f, v in enumerate(ps)], "stream_id string, frame long, period int, gain double, tapset int")
    got = by_stream(recurrence.comb_filter(streams(spark, x), p, size, 30), "y")
    for k in x:
        assert np.allclose(got[k], comb_loop(x[k], params[k], size, 30), atol=1e-9), k
