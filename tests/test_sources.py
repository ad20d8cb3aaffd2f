"""Containers built by hand, walked and reassembled."""

import struct

import pandas as pd

from sonaril.sources import demux, wav
from sonaril.streaming import stateful


def ogg_page(serial, page, granule, sizes, data, kind=0):
    return b"OggS" + struct.pack("<BBqIIIB", 0, kind, granule, serial, page, 0, len(sizes)) + bytes(sizes) + data


def test_ogg(spark):
    big = bytes(range(256)) * 3
    a = ogg_page(7, 0, 0, [5], b"hello", 2) + ogg_page(9, 0, 0, [3], b"xxx", 2)
    a += ogg_page(7, 1, 960, [255, 255, 255], big[:765]) + ogg_page(7, 2, 1920, [3, 0], big[765:])
    a += ogg_page(7, 3, 2000, [200], b"cut")
    df = spark.createDataFrame([("f", bytearray(a))], "stream_id string, content binary")
    rows = demux.ogg_packets(df).orderBy("packet_no").collect()
    assert [bytes(r.payload) for r in rows] == [b"hello", big, b""] and rows[1].granule == 1920


def box(name, body, wide=False):
    return (struct.pack(">I4sQ", 1, name, len(body) + 16) if wide else struct.pack(">I4s", len(body) + 8, name)) + body


def test_mp4_samples(spark):
    sizes, chunks = [10, 20, 30, 40, 50], [1000, 2000, 3000]
    stsz = box(b"stsz", struct.pack(">III", 0, 0, 5) + b"".join(struct.pack(">I", s) for s in sizes))
    stsc = box(b"stsc", struct.pack(">II", 0, 2) + struct.pack(">IIIIII", 1, 2, 1, 3, 1, 1))
    for table in (box(b"stco", struct.pack(">II", 0, 3) + b"".join(struct.pack(">I", c) for c in chunks)), box(b"co64", struct.pack(">II", 0, 3) + b"".join(struct.pack(">Q", c) for c in chunks))):
        moov = box(b"moov", box(b"trak", box(b"mdia", box(b"minf", box(b"stbl", stsz + stsc + table))), wide=True))
        df = spark.createDataFrame([("f", bytearray(box(b"ftyp", b"M4A ") + moov))], "stream_id string, content binary")
        got = demux.mp4_samples(df).orderBy("sample").collect()
        assert [(r.offset, r.size) for r in got] == [(1000, 10), (1010, 20), (2000, 30), (2030, 40), (3000, 50)]


def test_mp4_samples_of_one_size(spark):
    stsz, stsc = box(b"stsz", struct.pack(">III", 0, 7, 5)), box(b"stsc", struct.pack(">II", 0, 2) + struct.pack(">IIIIII", 1, 2, 1, 3, 1, 1))
    stco = box(b"stco", struct.pack(">IIIII", 0, 3, 1000, 2000, 3000))
    for tables in (stsz + stsc + stco, stco + stsc + stsz):  # entries of another box, or nothing, after the header
        moov = box(b"moov", box(b"trak", box(b"mdia", box(b"minf", box(b"stbl", tables)))))
        df = spark.createDataFrame([("f", bytearray(moov))], "stream_id string, content binary")
        got = demux.mp4_samples(df).orderBy("sample").collect()
        assert [(r.offset, r.size) for r in got] == [(1000, 7), (1007, 7), (2000, 7), (2007, 7), (3000, 7)]


def test_frame_walks():
    mp3 = b"ID3\x04\0\0\0\0\0\x04tags" + b"\xff" + (b"\xff\xfb\x90\x00" + b"\0" * 413) * 2 + b"TAG" + b"\0" * 125
    assert list(demux.mpeg_frames(mp3)) == [(15, 417), (432, 417)]
    unit = bytes([0xFF, 0xF1, 0x50, 0x80, 0x01, 0x5F, 0xFC]) + b"abc"
    assert list(demux.adts_frames(unit * 3)) == [(7, 3), (17, 3), (27, 3)]
    ac3 = (b"\x0b\x77\0\0\x00\x40" + b"\0" * 122) * 2
    assert list(demux.ac3_frames(b"junk" + ac3)) == [(4, 128), (132, 128)]
    assert [x[0] for x in demux.xiph_headers(bytes([2, 255, 1, 2]) + b"a" * 256 + b"bb" + b"ccc")] == [b"a" * 256, b"bb", b"ccc"]
    assert [k[0] for k in demux.flac_blocks(b"fLaC\0\0\0\x02xx\x84\0\0\x01y")] == [0, 4]


def test_opus_packets():
    f = demux.opus_frames
    assert list(f(bytes([0xF8]) + b"abc")) == [(1, 3, 31, None)]
    assert [x[:2] for x in f(bytes([0xF9]) + b"abcd")] == [(1, 2), (3, 2)]
    assert [x[:2] for x in f(bytes([0xFA, 1]) + b"abcd")] == [(2, 1), (3, 3)]
    assert [x[:2] for x in f(bytes([0xFB, 0x83, 1, 2]) + b"abbccc")] == [(4, 1), (5, 2), (7, 3)]
    assert [x[:2] for x in f(bytes([0xFB, 0x42, 3]) + b"aabb" + b"\0" * 3)] == [(3, 2), (5, 2)]
    assert next(iter(f(b"")))[3] == "empty packet" and next(iter(f(bytes([0xF9]) + b"abc")))[3] == "odd length"


def test_wav_round_trip(spark, tmp_path):
    wav.register(spark)
    df = spark.createDataFrame([("a/b", 1, 8000, [1, -2, 3]), ("c", 2, 44100, [5, 6, 7, 8])], wav.SCHEMA)
    df.write.format("wav").mode("append").save(str(tmp_path))
    got = {r.stream_id: (r.channels, r.sample_rate, r.samples) for r in spark.read.format("wav").load(str(tmp_path)).collect()}
    assert got == {"a/b": (1, 8000, [1, -2, 3]), "c": (2, 44100, [5, 6, 7, 8])}
    assert len(wav.wav_bytes([0] * 400, 2, 8000)) == 844
    long = spark.createDataFrame([("x", i, i) for i in range(25)], "stream_id string, n long, s int")
    assert {r.stream_id: r.samples for r in wav.blocks(long, 8000, 10).collect()} == {"x": list(range(10)), "x-1": list(range(10, 20)), "x-2": list(range(20, 25))}


def test_streams_in_ragged_pieces_equal_the_whole(spark, tmp_path):
    """Each file is a micro-batch."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    x = [(i * 7919) % 20001 - 10000 for i in range(700)]
    at, src = 0, tmp_path / "in"
    pieces = []
    for k, n in enumerate([150, 37, 1, 400, 112]):
        pieces.append(("a", k, x[at : at + n], at + n == len(x)))
        at += n
    for k in (1, 0, 2, 4, 0, 3):  # out of order, one twice
        spark.createDataFrame([pieces[k]], stateful.PIECES).coalesce(1).write.mode("append").parquet(str(src))
    pieces = spark.readStream.schema(stateful.PIECES).option("maxFilesPerTrigger", 1).parquet(str(src))
    whole = stateful.ResampleState(8000, 11025).push(pd.Series(x).to_numpy(float), True)
    for name, out in (("resampled", stateful.resample_stream(pieces, 8000, 11025)), ("framed", stateful.frame_stream(pieces, 160))):
        q = out.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
    assert [r.s for r in spark.table("resampled").orderBy("n").collect()] == list(whole)
    frames = spark.table("framed").orderBy("frame_no").collect()
    assert [len(r.samples) for r in frames] == [160] * 4 + [60] and [v for r in frames for v in r.samples] == x


def test_tag_frames_are_no_audio():
    head = b"\xff\xfb\x90\x00"
    tag, vbri = head + b"\0" * 32 + b"Xing" + b"\0" * 377, head + b"\0" * 32 + b"VBRI" + b"\0" * 377
    sound = head + b"\0" * 413
    assert list(demux.mpeg_frames(tag + sound + vbri + sound)) == [(417, 417), (1251, 417)]


def test_shared_folder_must_be_named_on_a_cluster():
    import pytest

    from sonaril.session import shared_folder

    class Conf:
        def get(self, key, default):
            return default

    class Cluster:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Cluster())
