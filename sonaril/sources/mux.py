"""Writers of container bytes from rows."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame


def ogg_pages(packets: list[bytes], serial: int = 1) -> bytes:
    """Packets as Ogg pages of at most 255 segments; packets go on over pages. Page checks are left zero."""
    segments: list[tuple[bytes, bool]] = []  # (at most 255 bytes, ends its packet)
    for p in packets:
        segments += [(p[i : i + 255], False) for i in range(0, len(p) - len(p) % 255, 255)]
        segments.append((p[len(p) - len(p) % 255 :], True))
    out = []
    for page, i in enumerate(range(0, len(segments), 255)):
        part = segments[i : i + 255]
        done = sum(end for _, end in segments[: i + 255]) if any(end for _, end in part) else -1
        kind = (1 if i and not segments[i - 1][1] else 0) | (2 if not i else 0) | (4 if i + 255 >= len(segments) else 0)
        out.append(b"OggS" + struct.pack("<BBqIIIB", 0, kind, done, serial, page, 0, len(part)) + bytes(len(s) for s, _ in part) + b"".join(s for s, _ in part))
    return b"".join(out)


def ogg_files(df: DataFrame, key: str, packets: list[str]) -> DataFrame:
    """(stream_id, content): each row's binary columns as the packets of one file."""

    def run(batches):
        for b in batches:
            rows = zip(*(b.column(i).to_pylist() for i in range(1, len(packets) + 1)), strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([ogg_pages([x or b"" for x in r]) for r in rows], pa.binary())], names=["stream_id", "content"])

    return df.select(df[key].cast("string").alias(key), *packets).mapInArrow(run, "stream_id string, content binary")


def mp4_bytes(samples: list[bytes], per_chunk: int = 2, config: bytes | None = None, media_time: int | None = None, gapless: tuple[int, int, int] | None = None) -> bytes:
    """Samples as an MP4 file of one track, in chunks of ``per_chunk``; samples of one size have it in the header only.

    With an audio configuration, the start of the first edit, and (delay, padding, samples) of the gapless tag where given.
    """

    def box(name: bytes, *parts: bytes) -> bytes:
        body = b"".join(parts)
        return struct.pack(">I4s", len(body) + 8, name) + body

    def table(name: bytes, head: list[int], entries: list[int]) -> bytes:
        return box(name, struct.pack(f">{len(head) + len(entries) + 1}I", 0, *head, *entries))

    sizes = [len(x) for x in samples]
    one = sizes[0] if len(set(sizes)) == 1 else 0
    chunks = [samples[i : i + per_chunk] for i in range(0, len(samples), per_chunk)]
    runs = [x for i, c in enumerate(chunks) if not i or len(c) != len(chunks[i - 1]) for x in (i + 1, len(c), 1)]
    front = box(b"ftyp", b"M4A ")
    at, bases = len(front) + 8, []
    for c in chunks:
        bases.append(at)
        at += sum(map(len, c))
    said, edits, tags = b"", b"", b""
    if config is not None:
        chain = bytes([5, len(config)]) + config
        chain = bytes([4, len(chain) + 13]) + bytes(13) + chain
        chain = bytes([3, 0x80, 0x80, len(chain) + 3]) + bytes(3) + chain
        said = box(b"stsd", struct.pack(">II", 0, 1), box(b"mp4a", bytes(28), box(b"esds", bytes(4), chain)))
    if media_time is not None:
        edits = box(b"edts", box(b"elst", struct.pack(">IIIII", 0, 1, 0, media_time, 0x10000)))
    if gapless is not None:
        text = " 00000000 {:08X} {:08X} {:016X}".format(*gapless).encode() + b" 00000000" * 8
        tags = box(b"udta", box(b"meta", bytes(4), box(b"ilst", box(b"----", box(b"name", bytes(4), b"iTunSMPB"), box(b"data", bytes(8), text)))))
    stbl = box(b"stbl", said, table(b"stsz", [one, len(sizes)], [] if one else sizes), table(b"stsc", [len(runs) // 3], runs), table(b"stco", [len(bases)], bases))
    return front + box(b"mdat", *samples) + box(b"moov", box(b"trak", edits, box(b"mdia", box(b"minf", stbl))), tags)


def mp4_files(df: DataFrame, key: str, samples: list[str]) -> DataFrame:
    """(stream_id, content): each row's binary columns as the samples of one file."""

    def run(batches):
        for b in batches:
            rows = zip(*(b.column(i).to_pylist() for i in range(1, len(samples) + 1)), strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([mp4_bytes([x or b"" for x in r]) for r in rows], pa.binary())], names=["stream_id", "content"])

    return df.select(df[key].cast("string").alias(key), *samples).mapInArrow(run, "stream_id string, content binary")


def mp4_described(df: DataFrame, key: str) -> DataFrame:
    """(stream_id, content) from rows (key, sample, config, media_time, delay, padding, samples): one-sample files; nulls are left out."""

    def run(batches):
        for b in batches:
            rows = zip(*(c.to_pylist() for c in b.columns), strict=True)
            out = [mp4_bytes([x or b""], config=config, media_time=time, gapless=None if delay is None else (delay, padding, n)) for _, x, config, time, delay, padding, n in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["stream_id", "content"])

    return df.select(df[key].cast("string").alias(key), "sample", "config", "media_time", "delay", "padding", "samples").mapInArrow(run, "stream_id string, content binary")
