"""The corpus pipeline on a small table."""

import random

import corpus_pipeline
from tests.llm.test_text_ops import words


def test_pipeline(spark, tmp_path):
    rng = random.Random(9)
    base = [words(rng, 90) for _ in range(30)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(base)]
    rows += [(100 + i, t, "en", "s", len(t)) for i, t in enumerate(base[:5])]
    shared = words(rng, 100)
    rows += [(200 + i, f"{words(rng, 150)} {shared} {words(rng, 150)}", "en", "s", 1) for i in range(2)]
    rows += [(300, "123 456", "en", "s", 7), (301, None, "en", "s", None), (302, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
        out.write.parquet(str(tmp_path / f"stage{i}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{i}"))
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert seen[0] == {r[0] for r in rows} - {300, 301, 302}
    assert seen[1] == set(range(30)) | {200, 201} and seen[2] == seen[1] == seen[3]
    cut = spark.read.parquet(str(tmp_path / "stage2")).filter("doc_id >= 200").collect()
    assert all(shared[100:-100] not in r.text and r.n_chars == len(r.text) for r in cut)
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(tuple, docs.collect()))


def test_repeated_passages_just_over_fifty_words_go(spark, tmp_path):
    rng = random.Random(11)
    w = words(rng, 5000).split()
    long, tiny, short = " ".join(w[:51]), " ".join("abcdefghijklmnopqrstuvwxy"[i * i % 23] for i in range(51)), " ".join(w[60:110])
    assert len(long) < 400 and len(tiny) == 101 and len(short) > 101
    rows = []
    for k, x in enumerate((long, tiny, short)):
        rows += [(10 * k + i, f"{words(rng, 120)} {i} {x} {i} {words(rng, 120)}", "en", "s", 1) for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.repeated_strings(spark, docs, str(tmp_path)).collect()}
    assert all(long not in got[i] and f" {i}  {i} " in got[i] for i in (0, 1))
    assert all(tiny not in got[10 + i] for i in (0, 1)) and all(got[i] == t for i, t, *_ in rows if i >= 20)
