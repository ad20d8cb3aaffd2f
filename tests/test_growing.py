"""Files that grow while a query reads them, and walks called from SQL."""

import random

import pytest

from sonaril.sources import growing, mux


def packets_of(rng, n):
    return [bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 254, 255, 256, 700, 70_000]))) for _ in range(n)]


def test_any_pieces_in_any_order():
    rng = random.Random(1)
    for _ in range(10):
        want = packets_of(rng, 12)
        body = mux.ogg_pages(want)
        cuts = sorted({0, len(body), *(rng.randrange(len(body)) for _ in range(20))})
        pieces = [(a, body[a:z]) for a, z in zip(cuts, cuts[1:], strict=False)]
        rng.shuffle(pieces)
        st, got = growing.PageState(), []
        for a, part in pieces + pieces[:3]:  # some come again
            got += st.push(a, part)
        assert got == list(enumerate(want)) and not st.rest and not st.early


def test_lost_and_broken_pieces(monkeypatch):
    monkeypatch.setattr(growing, "WAITING", 2)
    st = growing.PageState()
    st.push(10, b"x")
    st.push(12, b"x")
    with pytest.raises(ValueError, match="byte 0 is missing"):
        st.push(14, b"x")
    with pytest.raises(ValueError, match="no page"):
        growing.PageState().push(0, b"nothing that begins a page here")


def test_a_query_goes_on_where_files_have_grown(spark, tmp_path):
    rng = random.Random(2)
    want = {"a.ogg": packets_of(rng, 9), "b.ogg": packets_of(rng, 3)}
    body = {k: mux.ogg_pages(v) for k, v in want.items()}
    folder = tmp_path / "in"
    folder.mkdir()
    growing.register(spark)
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def run():
        pieces = spark.readStream.format("growing").option("path", str(folder)).option("ending", ".ogg").option("piece", "5000").load()
        q = growing.ogg_packet_stream(pieces).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((r.name, r.packet_no, bytes(r.payload)) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    try:
        seen = []
        for share in (0.3, 0.55, 1.0):
            for k, b in body.items():
                if k == "a.ogg" or share > 0.5:
                    (folder / k).write_bytes(b[: int(len(b) * share)])
            got = run()
            assert set(seen) <= set(got)
            seen = got
        assert seen == sorted((k, i, p) for k, ps in want.items() for i, p in enumerate(ps))
    finally:
        spark.conf.unset(provider)


def test_walks_in_sql(spark):
    growing.register_walks(spark)
    files = [("x", mux.ogg_pages([b"abc", b"", b"d" * 300])), ("y", None)]
    spark.createDataFrame(files, "name string, content binary").createOrReplaceTempView("some_files")
    got = spark.sql("SELECT name, seq, complete, octet_length(data) AS n FROM some_files, LATERAL ogg_fragments(content) ORDER BY seq").collect()
    assert [tuple(r) for r in got] == [("x", 0, True, 3), ("x", 1, True, 0), ("x", 2, True, 300)]
    boxes = spark.sql("SELECT path FROM (SELECT X'00000010667265650000000000000000' AS c), LATERAL mp4_boxes(c)").collect()
    assert len(boxes) == 1
