"""Operators against plain versions."""

import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sonaril.operators import framing, mixing, ordering, packets, predict, resample, spectral
from sonaril.streaming.stateful import ResampleState


def stream(spark, values, name="a"):
    return spark.createDataFrame(pd.DataFrame({"stream_id": name, "n": np.arange(len(values)), "s": np.array(values, np.int32)}), "stream_id string, n long, s int")


def test_ordinals_and_sums_over_blocks(spark):
    rng = random.Random(1)
    rows = [("x" if rng.random() < 0.8 else None, k, rng.randrange(-9, 9)) for k in rng.sample(range(5000), 700)]
    df = spark.createDataFrame(rows, "stream_id string, k long, v long").filter("stream_id IS NOT NULL")
    o = ordering.ordinal(df, ["stream_id"], "k", block=64).toPandas().sort_values("k")
    assert list(o.n) == list(range(len(o)))
    s = ordering.running_sum(df, ["stream_id"], "k", "v", "t", exclusive=True, block=64).toPandas().sort_values("k")
    assert list(s.t) == list(np.cumsum(s.v) - s.v)


def direct_resample(x, a, b):
    cutoff, half = resample.kernel_shape(a, b)
    k = resample.kernel_table(a, b)
    out, j = [], 0
    while half + j * a / b < len(x):
        p = half + j * a / b
        acc = 0.0
        for i in range(max(0, math.ceil(p - half)), min(len(x) - 1, math.floor(p + half)) + 1):
            d = abs(i - p) * 64
            if d < half * 64:
                f = int(d)
                acc += x[i] * ((1 - (d - f)) * k[f] + (d - f) * k[f + 1])
        out.append(int(max(-32768, min(32767, np.rint(acc)))))
        j += 1
    return out


def test_resampler(spark):
    rng = random.Random(2)
    x = [rng.randrange(-20000, 20000) for _ in range(900)]
    for a, b in ((44100, 8000), (8000, 16000), (48000, 48000)):
        want = direct_resample(x, a, b)
        got = resample.resample(stream(spark, x), a, b).toPandas().sort_values("n")
        assert list(got.s) == want
        st, pieces = ResampleState(a, b), []
        for i in range(0, len(x), 37):
            pieces += list(st.push(np.array(x[i : i + 37], float)))
        pieces += list(st.push(np.zeros(0), True))
        assert pieces == want


def test_constant_keeps_its_level(spark):
    y = resample.resample(stream(spark, [5000] * 3000), 44100, 8000).toPandas().sort_values("n").s.to_numpy()
    assert len(y) == math.ceil((3000 - 67) / (44100 / 8000)) and abs(y[30:-30] - 5000).max() <= 5


def test_predictors(spark):
    rng = random.Random(3)
    x = [rng.randrange(-32768, 32768) for _ in range(500)]
    for order in range(5):
        r = predict.fixed_residual(stream(spark, x), order)
        assert list(predict.fixed_predict(r, order, block=50).toPandas().sort_values("n").s) == x


def test_mixing_clips_once(spark):
    src = spark.createDataFrame([(0, 1, 30000), (0, 2, 30000), (0, 3, -30000), (1, 1, 7)], "n long, source int, s int")
    gains = spark.createDataFrame([(2, 0.5)], "source int, gain double")
    assert {r.n: r.s for r in mixing.mix(src).collect()} == {0: 30000, 1: 7}
    assert {r.n: r.s for r in mixing.mix(src, gains).collect()} == {0: 15000, 1: 7}


def test_mid_side_round_trip(spark):
    rng = random.Random(4)
    lr = [(rng.randrange(-32768, 32768), rng.randrange(-32768, 32768)) for _ in range(300)]
    rows = [("a", n, (l + r) >> 1, l - r) for n, (l, r) in enumerate(lr)]
    got = mixing.undo_decorrelation(spark.createDataFrame(rows, "stream_id string, n long, c0 int, c1 int"), "mid_side").toPandas().sort_values("n")
    assert list(zip(got.l, got.r, strict=True)) == lr


def test_frames_and_trim(spark):
    df = stream(spark, range(350))
    f = framing.tumbling(df).toPandas().sort_values("frame_no")
    assert list(f.len) == [160, 160, 30] and list(f.samples.iloc[2]) == list(range(320, 350))
    assert framing.trim(df, 10, 5).toPandas().sort_values("n").s.tolist() == [10, 11, 12, 13, 14]


def test_windows_are_power_complementary():
    for w in (spectral.kbd_window(512, 5.0), spectral.vorbis_slope(256), framing.celt_window()):
        assert all(abs(a * a + b * b - 1) < 1e-12 for a, b in zip(w, reversed(w), strict=True))
    full = spectral.vorbis_window(64, 16, True, False, True)
    assert len(full) == 64 and full[0] == 0.0 and full[16] == 1.0 or full[20] == 1.0


def test_transform_and_overlap_give_the_signal_back(spark):
    """Windowed blocks, their direct transform and the inverse with overlap: aliasing cancels."""
    n, rng = 16, np.random.default_rng(5)
    w = np.array(spectral.vorbis_slope(n // 2) + spectral.vorbis_slope(n // 2)[::-1])
    x = rng.normal(size=n // 2 * 9)
    basis = np.cos(2 * np.pi / n * (np.arange(n)[None, :] + 0.5 + n / 4) * (np.arange(n // 2)[:, None] + 0.5))
    rows = [(f, k, float(v)) for f in range(8) for k, v in enumerate(basis @ (w * x[f * n // 2 : f * n // 2 + n]))]
    y = spectral.imdct(spark.createDataFrame(rows, "frame long, k int, x double"), n)
    y = spectral.apply_window(y, [v * 4 / n for v in w])
    out = spectral.overlap_add(y, n).toPandas().sort_values(["frame", "i"])
    got = out[out.frame >= 1].y.to_numpy()
    assert np.allclose(got, x[n // 2 : n // 2 * 8], atol=1e-9)


def test_asof_and_lacing(spark):
    c = spark.createDataFrame([("a", k) for k in range(1, 8)], "stream_id string, chunk long")
    e = spark.createDataFrame([("a", 1, 3), ("a", 4, 1)], "stream_id string, first_chunk long, per_chunk int")
    got = packets.chunk_samples(c, e).toPandas().sort_values("chunk")
    assert list(got.per_chunk) == [3, 3, 3, 1, 1, 1, 1] and list(got.first_sample) == [0, 3, 6, 9, 10, 11, 12]
    seg = spark.createDataFrame([("a", i, v) for i, v in enumerate([255, 255, 10, 0, 255])], "stream_id string, seg long, size int")
    assert [(r.size, r.complete) for r in packets.lace(seg).orderBy("packet_no").collect()] == [(520, True), (0, True), (255, False)]


def test_carry_over(spark):
    df = spark.createDataFrame([("a", 0, 5), ("a", 1, None), ("a", 2, 7), ("a", 3, None)], "f string, b int, e int")
    assert [r.e for r in packets.last_known(df, ["f"], "b", "e").orderBy("b").collect()] == [5, 5, 7, 7]


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "stream_id string, n long, s int")
    assert resample.resample(none, 44100, 8000).count() == 0
    assert framing.tumbling(none).count() == 0
    assert predict.fixed_predict(none.withColumnRenamed("s", "r"), 2).count() == 0
    assert ordering.ordinal(none.select("stream_id", F.col("n").alias("k")), ["stream_id"], "k").count() == 0


def test_long_streams_by_blocks(spark):
    """Results don't depend on the size of the blocks that a stream is cut into."""
    from sonaril.operators import metrics, packets, predict, resample, spectral

    rows = [("a", i, (i * 7919) % 2001 - 1000) for i in range(300)] + [("b", i, i) for i in range(7)]
    s = spark.createDataFrame(rows, "stream_id string, n long, s int")
    seg = s.select("stream_id", F.col("n").alias("seg"), F.when(F.col("s") % 3 == 0, 255).otherwise(F.abs("s") % 200).alias("size"))
    gaps = s.withColumn("v", F.when(F.col("s") % 11 == 0, F.col("s"))).select("stream_id", (F.col("n") * 5).alias("n"), "v")
    marks = s.filter("n % 17 = 3").select("stream_id", F.col("n").alias("since"), F.col("s").alias("v"))
    y = s.select("stream_id", F.col("n").alias("block"), F.when(F.col("n") % 3 == 0, 8).otherwise(16).alias("n"), F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: (F.col("s") + i).cast("double")).alias("y"))
    y = y.withColumn("y", F.slice("y", F.lit(1), F.col("n")))
    for f in (
        lambda b: packets.lace(seg, block=b),
        lambda b: packets.last_known(gaps, ["stream_id"], "n", "v", block=b),
        lambda b: packets.asof(s, marks, ["stream_id"], "n", "since", ["v"], block=b),
        lambda b: predict.fixed_residual(s, 3, block=b),
        lambda b: spectral.lap_variable(y, block=b),
        lambda b: resample.resample(s, 8, 5, block=max(b, 1)),
        lambda b: metrics.best_lag(s, s.withColumn("n", F.col("n") + 3), 5, block=b),
        lambda b: packets.packet_times(seg.withColumnRenamed("seg", "packet"), block=b),
    ):
        small, large = ([tuple(r) for r in f(b).collect()] for b in (16, 1 << 20))
        assert sorted(small, key=repr) == sorted(large, key=repr) and small


def test_level_sums_follow_the_standard(spark):
    from sonaril.operators.packets import log_add_term

    # The standard's curve, first 64 steps.
    want = [64, 63, 62, 61, 60, 59, 58, 57, 56, 55, 54, 53, 52, 52, 51, 50, 49, 48, 47, 47, 46, 45, 44, 44, 43, 42, 41, 41, 40, 39, 38, 38]
    want += [37, 36, 36, 35, 35, 34, 33, 33, 32, 32, 31, 30, 30, 29, 29, 28, 28, 27, 27, 26, 26, 25, 25, 24, 24, 23, 23, 22, 22, 21, 21, 21]
    got = [r.v for r in spark.range(64).orderBy("id").select(log_add_term(F.col("id")).alias("v")).collect()]
    assert got == want


def test_permutations_and_spacing(spark):
    from sonaril.operators import floors, spectral

    assert [spectral.hadamard_order(n) for n in (2, 4, 8)] == [[1, 0], [3, 0, 2, 1], [7, 0, 4, 3, 6, 1, 5, 2]]
    df = spark.createDataFrame([([5, 5, 1, 32767],)], "x array<long>")
    least = [3, 10, 10, 10, 100]
    assert df.select(floors.space_apart("x", least).alias("y")).first().y == [3, 13, 23, 32668]


def test_fast_transform_equals_the_direct_sum():
    rng = np.random.default_rng(3)
    for n in (64, 128, 256, 512, 1024, 2048, 4096, 8192):
        x = rng.normal(size=(3, n // 2))
        want = x @ spectral.imdct_basis(n)
        assert np.abs(spectral.fast_imdct(n)(x) - want).max() < 1e-9 * max(1.0, np.abs(want).max())


def test_fast_transform_of_frames(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(5, 512))
    rows = [(f, int(k), float(x[f, k])) for f in range(5) for k in rng.permutation(512)]
    got = spectral.imdct(spark.createDataFrame(rows, "frame long, k int, x double"), 1024).toPandas().sort_values(["frame", "i"]).y.to_numpy().reshape(5, 1024)
    assert np.allclose(got, x @ spectral.imdct_basis(1024), atol=1e-9)
