"""Container walks as table functions.

Containers are chains of lengths, so each walk is a small generator over one payload; what it yields are
rows (pages, boxes, frames), and everything after that is relational. ``explode`` runs a walk over a
DataFrame of payloads in Arrow batches; files come from ``spark.read.format("binaryFile")``.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonaril.functions.headers import AC3_KBPS, L2_RATES, L3_RATES, LSF_RATES, SAMPLE_RATES


def files(spark, path: str, glob: str = "*") -> DataFrame:
    """(stream_id, content) of media files."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return f.select(F.col("path").alias("stream_id"), "content")


def explode(df: DataFrame, walk: Callable[[bytes], Iterator[tuple]], schema: str, key: str = "stream_id", payload: str = "content") -> DataFrame:
    """One row per item of each payload's walk, with its key and position ``seq``.

    A payload is one binary value (2 GB at most, less by ``spark.sql.sources.binaryFile.maxLength``).
    """
    kind = df.schema[key].dataType.simpleString()
    out = f"{key} {kind}, seq long, {schema}"

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(out))

    def run(batches):
        for b in batches:
            rows: list[list] = [[] for _ in target.names]
            for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for i, item in enumerate(walk(data or b"")):
                    for c, v in zip(rows, (k, i, *item), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, target.types, strict=True)], schema=target)

    return df.select(key, payload).mapInArrow(run, out)


# --------------------------------------------------------------------------- Ogg
OGG = "serial long, page_seq long, granule long, bos boolean, eos boolean, complete boolean, data binary"


def ogg_fragments(b: bytes) -> Iterator[tuple]:
    """Packets and packet fragments page by page; a cut-off page ends the walk."""
    at = 0
    while at + 27 <= len(b) and b[at : at + 4] == b"OggS":
        kind = b[at + 5]
        granule, serial, page = struct.unpack_from("<qII", b, at + 6)
        lacing = b[at + 27 : at + 27 + b[at + 26]]
        data = at + 27 + len(lacing)
        if len(lacing) < b[at + 26] or data + sum(lacing) > len(b):
            return
        start = data
        for v in lacing:
            data += v
            if v < 255:
                yield serial, page, granule, bool(kind & 2), bool(kind & 4), True, b[start:data]
                start = data
        if lacing and lacing[-1] == 255:
            yield serial, page, granule, bool(kind & 2), bool(kind & 4), False, b[start:data]
        at = data


def ogg_packets(df: DataFrame) -> DataFrame:
    """(stream_id, packet_no, granule, payload) of each file's first logical stream."""
    from sonaril.operators.packets import reassemble

    f = explode(df, ogg_fragments, OGG)
    return reassemble(f.select("stream_id", "serial", "seq", "complete", "granule", "data"))


# --------------------------------------------------------------------------- MP4
BOXES = "path string, start long, stop long"
_NEST = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"udta"}


def mp4_boxes(b: bytes, lo: int = 0, hi: int | None = None, path: str = "") -> Iterator[tuple]:
    """Every box's path and content range; 64-bit sizes, and size 0 for "to the end"."""
    hi = len(b) if hi is None else hi
    while lo + 8 <= hi:
        size, name = struct.unpack_from(">I4s", b, lo)
        head = 8
        if size == 1 and lo + 16 <= hi:
            size, head = struct.unpack_from(">Q", b, lo + 8)[0], 16
        elif size == 0:
            size = hi - lo
        if size < head:
            return
        stop = min(lo + size, hi)
        here = f"{path}/{name.decode('latin-1')}"
        yield here, lo + head, stop
        if name in _NEST:
            yield from mp4_boxes(b, lo + head, stop, here)
        lo += size


def box_table(df: DataFrame) -> DataFrame:
    return explode(df, mp4_boxes, BOXES)


def _u32_items(df: DataFrame, boxes: DataFrame, suffix: str, skip: int, width: int) -> DataFrame:
    """(stream_id, i, head binary, w binary): the ``width``-byte entries of a counted table box, exploded by position, and the box's ``skip`` bytes before them."""
    b = boxes.filter(F.col("path").endswith(suffix)).groupBy("stream_id").agg(F.min_by(F.struct("start", "stop"), "seq").alias("r"))
    t = df.join(b, "stream_id").select("stream_id", F.substring("content", F.col("r.start").cast("int") + 1, (F.col("r.stop") - F.col("r.start")).cast("int")).alias("t"))
    from sonaril.functions.bits import unsigned_be

    n = unsigned_be("t", skip - 4, 4)
    some = t.withColumn("n", n).filter("n > 0")
    rows = some.select("stream_id", "t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    at = (F.col("i") * width + skip + 1).cast("int")
    return rows.select("stream_id", "i", F.substring("t", 1, skip).alias("head"), F.substring("t", at, F.lit(width)).alias("w"))


def mp4_samples(df: DataFrame) -> DataFrame:
    """(stream_id, sample, offset, size): chunk offsets, the run table by an as-of join, and running sizes."""
    from sonaril.functions.bits import unsigned_be
    from sonaril.operators.ordering import running_sum
    from sonaril.operators.packets import chunk_samples

    boxes = box_table(df)
    word = lambda c, at=0: unsigned_be(c, at, 4)
    chunks = _u32_items(df, boxes, "/stbl/stco", 8, 4).select("stream_id", (F.col("i") + 1).alias("chunk"), word("w").alias("base"))
    wide = _u32_items(df, boxes, "/stbl/co64", 8, 8).select("stream_id", (F.col("i") + 1).alias("chunk"), unsigned_be("w", 0, 8).alias("base"))
    chunks = chunks.unionByName(wide)
    runs = _u32_items(df, boxes, "/stbl/stsc", 8, 12).select("stream_id", word("w").alias("first_chunk"), word("w", 4).cast("int").alias("per_chunk"))
    # a size in the header that isn't zero holds for every sample, and no entries follow
    size = F.when(word("head", 4) != 0, word("head", 4)).otherwise(word("w"))
    sizes = _u32_items(df, boxes, "/stbl/stsz", 12, 4).select("stream_id", F.col("i").alias("sample"), size.alias("size"))
    placed = chunk_samples(chunks, runs).filter("per_chunk > 0")
    each = placed.select("stream_id", "base", "chunk", F.explode(F.expr("sequence(first_sample, first_sample + per_chunk - 1)")).alias("sample"), "first_sample")
    summed = running_sum(sizes, ["stream_id"], "sample", "size", "before", exclusive=True)
    got = each.join(summed, ["stream_id", "sample"])
    first = summed.select("stream_id", F.col("sample").alias("first_sample"), F.col("before").alias("ahead"))
    return got.join(first, ["stream_id", "first_sample"]).select("stream_id", "sample", (F.col("base") + F.col("before") - F.col("ahead")).alias("offset"), "size")


def mp4_timing(df: DataFrame) -> DataFrame:
    """(stream_id, media_time, delay, padding, samples, object_type, rate_index, channel_config) of every file; null where it doesn't say.

    The first edit's start (an empty edit says nothing), the gapless tag's three numbers, and the audio configuration
    at the end of the descriptor chain. All are found in the boxes by position or pattern, without decoding.
    """
    from sonaril.functions.bits import byte_at, unsigned_be
    from sonaril.functions.headers import audio_config

    edits = box_table(df).filter(F.col("path").endswith("/trak/edts/elst")).groupBy("stream_id").agg(F.min_by(F.struct("start", "stop"), "seq").alias("r"))
    body = F.substring("content", F.col("r.start").cast("int") + 1, (F.col("r.stop") - F.col("r.start")).cast("int"))
    time = F.when(byte_at("t", 0) == 1, unsigned_be("t", 16, 8)).otherwise(unsigned_be("t", 12, 4))
    fine = (F.octet_length("t") > 16) & (unsigned_be("t", 4, 4) > 0) & (time > 0) & (time != 0xFFFFFFFF)
    first = df.join(edits, "stream_id").select("stream_id", body.alias("t")).select("stream_id", F.when(fine, time).alias("media_time"))
    text = F.decode("content", "iso-8859-1")
    number = lambda i: F.nullif(F.regexp_extract(text, r"(?s)iTunSMPB.{4}data.{18}([0-9A-Fa-f]{8}).([0-9A-Fa-f]{8}).([0-9A-Fa-f]{16})", i), F.lit(""))
    size = r"[\x80-\xff]{0,3}[\x00-\x7f]"
    chain = rf"(?s)esds.{{4}}\x03{size}.{{3}}\x04{size}.{{13}}\x05{size}(.{{1,8}})"
    config = audio_config(F.encode(F.regexp_extract(text, chain, 1), "iso-8859-1"))
    said = df.select("stream_id", *[F.conv(number(i), 16, 10).cast("long").alias(c) for i, c in ((1, "delay"), (2, "padding"), (3, "samples"))], F.when(F.regexp_extract(text, chain, 1) != "", config).alias("c"))
    return said.join(first, "stream_id", "left").select("stream_id", "media_time", "delay", "padding", "samples", "c.object_type", "c.rate_index", "c.channel_config")


# --------------------------------------------------------------------------- frames chained by their lengths
FRAMES = "start long, size long"


def is_vbr_tag(b: bytes, at: int) -> bool:
    """Whether the layer III frame at an offset is a variable-rate tag without audio."""
    mpeg1, mono = b[at + 1] >> 3 & 3 == 3, b[at + 3] >> 6 == 3
    side = (17 if mono else 32) if mpeg1 else (9 if mono else 17)
    return b[at + 4 + side : at + 8 + side] in (b"Xing", b"Info") or b[at + 36 : at + 40] == b"VBRI"


def mpeg_frames(b: bytes, layer: int = 3) -> Iterator[tuple]:
    """Audio frames of an MPEG stream between its tags: the next offset whose header is valid and whose frame fits."""
    at, end = 0, len(b)
    if b[:3] == b"ID3" and end >= 10:
        at = 10 + ((b[6] & 127) << 21 | (b[7] & 127) << 14 | (b[8] & 127) << 7 | b[9] & 127)
    if end >= 128 and b[end - 128 : end - 125] == b"TAG":
        end -= 128
    while at + 4 <= end:
        size = mpeg_frame_size(b[at : at + 4], layer)
        if size and size >= 4 and at + size <= end:
            if layer != 3 or not is_vbr_tag(b, at):
                yield at, size
            at += size
        else:
            at += 1


def mpeg_frame_size(h: bytes, layer: int = 3) -> int:
    """Frame length of a header, 0 if it is none of the layer."""
    w = int.from_bytes(h, "big")
    version, br, sr = w >> 19 & 3, w >> 12 & 15, w >> 10 & 3
    if w >> 21 != 0x7FF or version == 1 or 4 - (w >> 17 & 3) != layer or br in (0, 15) or sr == 3:
        return 0
    rate = (((L2_RATES if layer == 2 else L3_RATES) if version == 3 else LSF_RATES)[br]) * 1000
    hz = SAMPLE_RATES[sr] // {3: 1, 2: 2, 0: 4}[version]
    return (144 if layer == 2 or version == 3 else 72) * rate // hz + (w >> 9 & 1)


def adts_frames(b: bytes) -> Iterator[tuple]:
    """Access units of an ADTS stream without their headers; a broken header ends it."""
    at = 0
    while at + 7 < len(b) and b[at] == 0xFF and b[at + 1] & 0xF6 == 0xF0:
        size = (b[at + 3] & 3) << 11 | b[at + 4] << 3 | b[at + 5] >> 5
        head = 7 if b[at + 1] & 1 else 9
        if size <= head or at + size > len(b):
            return
        yield at + head, size - head
        at += size


def ac3_frames(b: bytes) -> Iterator[tuple]:
    """Frames of an AC-3 stream, from its first sync on."""
    at = max(b.find(b"\x0b\x77"), 0)
    while at + 6 <= len(b) and b[at : at + 2] == b"\x0b\x77":
        rate, code = b[at + 4] >> 6, b[at + 4] & 63
        if rate == 3 or code > 37 or b[at + 5] >> 3 > 10:
            return
        kbps = AC3_KBPS[code >> 1]
        size = 2 * (kbps * 2, kbps * 96000 // 44100 + (code & 1), kbps * 3)[rate]
        if at + size > len(b):
            return
        yield at, size
        at += size


OPUS = "start long, size long, config int, error string"


def opus_frames(b: bytes) -> Iterator[tuple]:
    """Frames of an Opus packet by its count code; a malformed packet is one row with an error."""
    if not b:
        yield 0, 0, None, "empty packet"
        return
    config, code, at, left = b[0] >> 3, b[0] & 3, 1, len(b) - 1
    spf = (120, 240, 480, 960)[config & 3] if config >= 16 else (480, 960)[config & 1] if config >= 12 else (480, 960, 1920, 2880)[config & 3]

    def length() -> int:
        """A one- or two-byte length at ``at``; -1 if it is cut off."""
        nonlocal at, left
        if left < 1 or b[at] >= 252 and left < 2:
            return -1
        n = b[at] if b[at] < 252 else b[at] + 4 * b[at + 1]
        used = 1 if b[at] < 252 else 2
        at, left = at + used, left - used
        return n

    sizes: list[int] = []
    error = None
    if code == 0:
        sizes = [left]
    elif code == 1:
        error = "odd length" if left % 2 else None
        sizes = [left // 2] * 2
    elif code == 2:
        first = length()
        error = "bad size" if first < 0 or first > left else None
        sizes = [first, left - first]
    elif left < 1:
        error = "truncated"
    else:
        head = b[at]
        at, left = at + 1, left - 1
        count = head & 63
        if not count or spf * count > 5760:
            error = "bad frame count"
        pad = head & 64
        while pad and not error:
            if left <= 0:
                error = "padding overflow"
                break
            p = b[at]
            at, left = at + 1, left - 1 - (254 if p == 255 else p)
            pad = p == 255
        if not error and left < 0:
            error = "negative length"
        if not error and head & 128:
            for _ in range(count - 1):
                n = length()
                if n < 0 or n > left:
                    error = "bad size"
                    break
                sizes.append(n)
            sizes.append(left - sum(sizes))
            error = error or ("bad size" if sizes[-1] < 0 else None)
        elif not error:
            error = "not divisible" if left % count else None
            sizes = [left // count] * count
    if not error and sizes and sizes[-1] > 1275:
        error = "last frame too large"
    if error:
        yield 0, 0, config, error
        return
    for n in sizes:
        yield at, n, config, None
        at += n


XIPH = "data binary"


def xiph_headers(b: bytes) -> Iterator[tuple]:
    """Headers laced in a container's private data: count - 1, lengths as runs of 255, then the bodies."""
    if not b:
        return
    count, at, sizes = b[0] + 1, 1, []
    for _ in range(count - 1):
        n = 0
        while at < len(b):
            n, at = n + b[at], at + 1
            if b[at - 1] != 255:
                break
        sizes.append(n)
    for n in sizes:
        yield (b[at : at + n],)
        at += n
    yield (b[at:],)


FLAC_BLOCKS = "kind int, start long, size long, last boolean"


def flac_blocks(b: bytes) -> Iterator[tuple]:
    """Metadata blocks of a native stream."""
    at = 4 if b[:4] == b"fLaC" else len(b)
    while at + 4 <= len(b):
        size = int.from_bytes(b[at + 1 : at + 4], "big")
        yield b[at] & 127, at + 4, size, bool(b[at] & 128)
        if b[at] & 128:
            return
        at += 4 + size
