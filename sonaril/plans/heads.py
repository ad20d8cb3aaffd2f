"""Queries on stream heads, container metadata and packet chains, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from sonaril.functions import bits, headers
from sonaril.operators import packets, signals
from sonaril.plans.catalog import RAW, SIG, _byte, query, raw
from sonaril.sources import demux, mux

#: a document's first bytes as a list of numbers
HEAD = RAW + f", h AS (SELECT doc_id, len, list_transform(range(least(len, 64)), lambda i: CAST({_byte('i')} AS BIGINT)) AS b FROM raw)"


def _le(at: int, n: int) -> str:
    """Little-endian number from byte ``at`` of the list b."""
    return "(" + " + ".join(f"b[{at + k + 1}] * {1 << 8 * k}" for k in range(n)) + ")"


def _be(at: int, n: int) -> str:
    return "(" + " + ".join(f"b[{at + k + 1}] * {1 << 8 * (n - 1 - k)}" for k in range(n)) + ")"


def _signed(x: str, n: int) -> str:
    return f"(CASE WHEN {x} >= {1 << (n - 1)} THEN {x} - {1 << n} ELSE {x} END)"


def _hex(x: bytes):
    return F.unhex(F.lit(x.hex()))


@query(f"WITH {HEAD} SELECT doc_id, CAST(b[1] AS INTEGER) AS version, CAST(b[2] AS INTEGER) AS channels, CAST({_le(2, 2)} AS INTEGER) AS pre_skip, {_le(4, 4)} AS input_rate, CAST({_signed(_le(8, 2), 16)} AS INTEGER) AS output_gain, CAST(b[11] AS INTEGER) AS mapping_family FROM h WHERE len >= 11")
def opus_head_parse(spark, sf):
    h = raw(spark, sf).select("doc_id", headers.opus_head(F.concat(_hex(b"OpusHead"), "b")).alias("h")).filter("h IS NOT NULL")
    return h.select("doc_id", "h.*")


_SIZES = "CASE doc_id % 4 WHEN 0 THEN 184 WHEN 1 THEN 134 WHEN 2 THEN 139 ELSE 85 END"


@query(f"""WITH {HEAD}, v AS (SELECT doc_id, b, {_SIZES} AS z FROM h WHERE len >= 17 AND b[1] > 0)
SELECT doc_id, CAST(b[1] AS INTEGER) AS channels, {_le(1, 4)} AS rate, {_signed(_le(5, 4), 32)} AS most, {_signed(_le(9, 4), 32)} AS nominal, {_signed(_le(13, 4), 32)} AS least, CAST(1 << (z & 15) AS INTEGER) AS short_block, CAST(1 << (z >> 4) AS INTEGER) AS long_block
FROM v WHERE (z & 15) <= (z >> 4) AND (z & 15) BETWEEN 6 AND 13 AND (z >> 4) BETWEEN 6 AND 13""")
def vorbis_identification_parse(spark, sf):
    """Documents as headers with block sizes of four kinds, two of which no stream may have."""
    sizes = F.when(F.col("doc_id") % 4 == 0, _hex(b"\xb8")).when(F.col("doc_id") % 4 == 1, _hex(b"\x86")).when(F.col("doc_id") % 4 == 2, _hex(b"\x8b")).otherwise(_hex(b"\x55"))
    r = raw(spark, sf).filter(F.octet_length("b") >= 17)
    h = r.select("doc_id", headers.vorbis_identification(F.concat(_hex(b"\x01vorbis\0\0\0\0"), F.substring("b", 1, 17), sizes, _hex(b"\x01"))).alias("h")).filter("h IS NOT NULL")
    return h.select("doc_id", "h.*")


@query(f"WITH {HEAD} SELECT doc_id, CASE WHEN b[1] % 2 = 1 THEN 0 WHEN (b[1] >> 1) & 3 = 0 THEN 256 WHEN (b[1] >> 1) & 3 = 2 THEN 256 WHEN (b[1] >> 1) & 3 = 1 THEN 2048 ELSE 0 END AS size FROM h WHERE len > 0")
def vorbis_block_sizes(spark, sf):
    r = raw(spark, sf).filter(F.octet_length("b") > 0)
    return r.select("doc_id", headers.vorbis_block_size("b", [False, True, False], 256, 2048).alias("size"))


_BLK = f"{SIG}, p AS (SELECT stream_id, n AS packet, CASE WHEN abs(s) % 5 = 0 THEN 0 WHEN abs(s) % 3 = 0 THEN 2048 ELSE 256 END AS size FROM sig)"


@query(f"""WITH {_BLK}, a AS (SELECT *, coalesce((lag(size) OVER (PARTITION BY stream_id ORDER BY packet) + size) // 4, 0) AS samples FROM p WHERE size > 0)
SELECT stream_id, packet, CAST(size AS INTEGER) AS size, CAST(samples AS BIGINT) AS samples, CAST(coalesce(sum(samples) OVER (PARTITION BY stream_id ORDER BY packet ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS time FROM a""")
def vorbis_packet_times(spark, sf):
    s = F.abs("s")
    p = signals.sig(spark, sf).select("stream_id", F.col("n").alias("packet"), F.when(s % 5 == 0, 0).when(s % 3 == 0, 2048).otherwise(256).alias("size"))
    return packets.packet_times(p, block=1 << 12)


@query(f"""WITH {HEAD}, f AS (SELECT doc_id, b, {_be(10, 4)} AS w, array_to_string(list_transform(range(16), lambda i: lpad(lower(hex(b[19 + i])), 2, '0')), '') AS md5 FROM h WHERE len >= 34)
SELECT doc_id, {_be(0, 2)} AS min_block, {_be(2, 2)} AS max_block, {_be(4, 3)} AS min_frame, {_be(7, 3)} AS max_frame, w >> 12 AS sample_rate, ((w >> 9) & 7) + 1 AS channels, ((w >> 4) & 31) + 1 AS bits, (w & 15) * 4294967296 + {_be(14, 4)} AS total_samples, md5 FROM f WHERE ((w >> 4) & 31) + 1 >= 4""")
def flac_streaminfo_parse(spark, sf):
    r = raw(spark, sf).filter(F.octet_length("b") >= 34)
    h = r.select("doc_id", headers.flac_streaminfo(F.concat(_hex(b"fLaC\x00\x00\x00\x22"), F.substring("b", 1, 34))).alias("h")).filter("h IS NOT NULL")
    return h.select("doc_id", "h.*")


# --------------------------------------------------------------------------- layer III side information
def _side_sql() -> str:
    """One SELECT for each layout, granule and channel; the layouts are spelled out bit by bit."""
    out = []
    for mpeg1 in (True, False):
        for channels in (1, 2):
            kind = 2 * mpeg1 + channels - 1
            at = 0

            def take(n: int) -> str:
                nonlocal at
                lo, hi = at // 8, (at + n - 1) // 8
                x = f"(({_be(lo, hi - lo + 1)} >> {8 * (hi + 1) - at - n}) & {(1 << n) - 1})"
                at += n
                return x

            back = take(9 if mpeg1 else 8)
            take((5 if channels == 1 else 3) if mpeg1 else channels)
            shared = [[take(1) for _ in range(4)] for _ in range(channels)] if mpeg1 else [["0"] * 4] * channels
            for gr in range(2 if mpeg1 else 1):
                for ch in range(channels):
                    c = {"part2_3_length": take(12), "big_values": take(9), "global_gain": take(8), "scalefac_compress": take(4 if mpeg1 else 9), "win_switch": take(1)}
                    here = at
                    short = {"block_type": take(2), "mixed": take(1), "t": [take(5), take(5)], "g": [take(3) for _ in range(3)]}
                    at = here
                    long_ = {"t": [take(5) for _ in range(3)], "r0": take(4), "r1": take(3)}
                    pre = take(1) if mpeg1 else "0"
                    rest = {"preflag": pre, "scalefac_scale": take(1), "count1table_select": take(1)}
                    on = f"{c['win_switch']} = 1"
                    region = f"(CASE WHEN {short['block_type']} = 2 AND {short['mixed']} = 0 THEN 8 ELSE 7 END)"
                    cols = {"main_data_begin": back, "gr": gr, "ch": ch} | c | {
                        "block_type": f"CASE WHEN {on} THEN {short['block_type']} ELSE 0 END",
                        "mixed": f"CASE WHEN {on} THEN {short['mixed']} ELSE 0 END",
                        "region0": f"CASE WHEN {on} THEN {region} ELSE {long_['r0']} END",
                        "region1": f"CASE WHEN {on} THEN 20 - {region} ELSE {long_['r1']} END",
                    } | rest
                    texts = {
                        "table_select": f"CASE WHEN {on} THEN concat_ws(' ', {', '.join(short['t'])}) ELSE concat_ws(' ', {', '.join(long_['t'])}) END",
                        "subblock_gain": f"CASE WHEN {on} THEN concat_ws(' ', {', '.join(short['g'])}) ELSE '0 0 0' END",
                        "scfsi": f"concat_ws(' ', {', '.join(shared[ch])})",
                    }
                    cells = [f"CAST({v} AS INTEGER) AS {k}" for k, v in cols.items()] + [f"{v} AS {k}" for k, v in texts.items()]
                    out.append(f"SELECT doc_id, {', '.join(cells)} FROM h WHERE len >= 32 AND doc_id % 4 = {kind}")
    return f"WITH {HEAD} " + " UNION ALL ".join(out)


@query(_side_sql())
def side_info_parse(spark, sf):
    """Documents as side information of the four layouts."""
    r = raw(spark, sf).filter(F.octet_length("b") >= 32)
    kind = F.col("doc_id") % 4
    s = r.select("doc_id", F.explode(headers.side_info("b", kind >= 2, 1 + kind % 2)).alias("x")).select("doc_id", "x.*")
    for c in ("table_select", "subblock_gain", "scfsi"):
        s = s.withColumn(c, F.array_join(F.col(c).cast("array<string>"), " "))
    return s


@query(f"WITH {SIG}, f AS (SELECT stream_id, n AS frame, 100 + abs(s) % 300 AS size, abs(s) % 512 AS back FROM sig), g AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY stream_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - back AS start FROM f) SELECT stream_id, frame, CAST(size AS INTEGER) AS size, CAST(back AS INTEGER) AS back, CAST(start AS BIGINT) AS start, start >= 0 AS whole FROM g")
def bit_reservoir(spark, sf):
    f = signals.sig(spark, sf).select("stream_id", F.col("n").alias("frame"), (100 + F.abs("s") % 300).alias("size"), (F.abs("s") % 512).alias("back"))
    return packets.main_data(f, block=1 << 12)


_TAGS = "['Xing', 'Info', 'VBRI', 'Data']"


@query(f"WITH {RAW}, t AS (SELECT doc_id, doc_id % 4 AS tag, (doc_id // 4) % 2 = 0 AS mpeg1, 1 + (doc_id // 8) % 2 AS channels FROM raw) SELECT doc_id, CASE WHEN mpeg1 THEN 'mpeg1' ELSE 'mpeg2' END AS version, CAST(channels AS INTEGER) AS channels, {_TAGS}[tag + 1] AS name, tag <= 2 AS is_tag FROM t")
def vbr_tag_scan(spark, sf):
    """Frames with a name where a variable-rate tag stands, or at byte 36; the bytes before are zero, those after the document."""
    d = raw(spark, sf).select("doc_id", "b", (F.col("doc_id") % 4).alias("tag"), F.when(F.floor(F.col("doc_id") / 4) % 2 == 0, "mpeg1").otherwise("mpeg2").alias("version"), (1 + F.floor(F.col("doc_id") / 8) % 2).cast("int").alias("channels"))
    name = F.element_at(F.array(*[F.lit(x) for x in ("Xing", "Info", "VBRI", "Data")]), (F.col("tag") + 1).cast("int"))
    before = F.when(F.col("tag") == 2, 32).otherwise(headers.side_info_size("version", "channels"))
    frame = F.concat(_hex(b"\xff\xfb\x90\x00"), F.unhex(F.repeat(F.lit("00"), before)), F.encode(name, "utf-8"), "b")
    return d.select("doc_id", "version", "channels", name.alias("name"), headers.vbr_tag(frame, "version", "channels").alias("is_tag"))


# --------------------------------------------------------------------------- containers
@query(f"""WITH {RAW}, d AS (SELECT doc_id, len, doc_id % 3 AS kind FROM raw)
SELECT CAST(doc_id AS VARCHAR) AS stream_id, CASE WHEN kind <> 1 THEN CAST(1024 + doc_id AS BIGINT) END AS media_time, CASE WHEN kind <> 2 THEN CAST(2112 + doc_id % 7 AS BIGINT) END AS delay, CASE WHEN kind <> 2 THEN CAST(len % 1024 AS BIGINT) END AS padding, CASE WHEN kind <> 2 THEN CAST(len AS BIGINT) * 1000 END AS samples,
CAST(CASE WHEN doc_id % 5 = 0 THEN 36 ELSE 2 END AS INTEGER) AS object_type, CAST(doc_id % 12 AS INTEGER) AS rate_index, CAST(1 + doc_id % 2 AS INTEGER) AS channel_config FROM d""")
def mp4_metadata(spark, sf):
    """Documents as one-sample files with an edit, a gapless tag, or both, and configurations with and without an escaped type."""
    d, n = F.col("doc_id"), F.octet_length("b")
    plain = F.hex(((2 * 16 + d % 12) * 16 + 1 + d % 2) * 8)  # five bits of type, four of rate, four of channels
    wide = F.hex((((31 * 64 + 4) * 16 + d % 12) * 16 + 1 + d % 2) * 32)
    config = F.when(d % 5 == 0, F.unhex(F.lpad(wide, 6, "0"))).otherwise(F.unhex(F.lpad(plain, 4, "0")))
    rows = raw(spark, sf).select("doc_id", F.col("b").alias("sample"), config.alias("config"), F.when(d % 3 != 1, 1024 + d).alias("media_time"), F.when(d % 3 != 2, 2112 + d % 7).alias("delay"), (n % 1024).alias("padding"), (n.cast("long") * 1000).alias("samples"))
    return demux.mp4_timing(mux.mp4_described(rows, "doc_id"))


@query(f"""WITH {RAW}, d AS (SELECT doc_id, doc_id % 3 AS pre FROM raw WHERE doc_id % 4 <> 3)
SELECT CAST(doc_id AS VARCHAR) AS stream_id, CAST(pre AS INTEGER) AS pre_skip, CAST(2 AS INTEGER) AS channels, CAST(1 AS BIGINT) AS packets, CAST(3 AS BIGINT) AS last_granule, CAST(3 - pre AS BIGINT) AS keep FROM d""")
def opus_stream_trim(spark, sf):
    """Documents as the one audio packet of files with a head and tags (a quarter without a head)."""
    d = F.col("doc_id")
    magic = F.when(d % 4 == 3, _hex(b"OpusTail")).otherwise(_hex(b"OpusHead"))
    pre = F.unhex(F.concat(F.lpad(F.hex(d % 3), 2, "0"), F.lit("00")))
    f = raw(spark, sf).select("doc_id", F.concat(magic, _hex(b"\x01\x02"), pre, _hex(bytes(7))).alias("head"), _hex(b"OpusTags").alias("tags"), F.md5("b").cast("binary").alias("sound"))
    got = packets.opus_audio(demux.ogg_packets(mux.ogg_files(f, "doc_id", ["head", "tags", "sound"])))
    return got.select("stream_id", "head.pre_skip", "head.channels", "packets", "last_granule", "keep")


@query("WITH d AS (SELECT doc_id, repeat(md5(text), CAST(1 + doc_id % 20 AS INTEGER)) AS a, coalesce(lang, '') AS b, text AS c FROM documents WHERE text IS NOT NULL) SELECT doc_id, CAST(unnest([0, 1, 2]) AS BIGINT) AS seq, unnest([md5(a), md5(b), md5(c)]) AS md5 FROM d")
def xiph_headers_split(spark, sf):
    """Three headers laced in private data, the first of up to 640 bytes."""
    d = signals.table(spark, sf, "documents").filter("text IS NOT NULL")
    a, b, c = F.repeat(F.md5(F.encode("text", "utf-8")), (1 + F.col("doc_id") % 20).cast("int")), F.coalesce("lang", F.lit("")), F.col("text")
    laced = lambda x: F.concat(F.unhex(F.repeat(F.lit("FF"), F.floor(F.octet_length(x) / 255).cast("int"))), F.unhex(F.lpad(F.hex(F.octet_length(x) % 255), 2, "0")))
    private = F.concat(_hex(b"\x02"), laced(a), laced(b), *(F.encode(x, "utf-8") for x in (a, b, c)))
    h = demux.explode(d.select("doc_id", private.alias("private")), demux.xiph_headers, demux.XIPH, "doc_id", "private")
    return h.select("doc_id", "seq", F.md5("data").alias("md5"))


@query(f"""WITH {HEAD}, t AS (SELECT doc_id, b, len, b[1] & 3 AS code, b[1] >> 3 AS config, CASE WHEN b[2] >= 252 THEN b[2] + 4 * b[3] ELSE b[2] END AS n2, CASE WHEN b[2] >= 252 THEN 2 ELSE 1 END AS used FROM h WHERE len > 0 AND b[1] & 3 <> 3 AND len <= 1200),
e AS (SELECT *, CASE WHEN code = 1 AND (len - 1) % 2 = 1 THEN 'odd length' WHEN code = 2 AND (len < 2 OR b[2] >= 252 AND len < 3 OR n2 > len - 1 - used) THEN 'bad size' END AS error FROM t)
SELECT doc_id, CAST(seq AS BIGINT) AS seq, CAST(start AS BIGINT) AS start, CAST(size AS BIGINT) AS size, CAST(config AS INTEGER) AS config, error FROM (
SELECT doc_id, 0 AS seq, 0 AS start, 0 AS size, config, error FROM e WHERE error IS NOT NULL
UNION ALL SELECT doc_id, 0, 1, len - 1, config, NULL FROM e WHERE error IS NULL AND code = 0
UNION ALL SELECT doc_id, k, 1 + k * ((len - 1) // 2), (len - 1) // 2, config, NULL FROM e, (VALUES (0), (1)) s(k) WHERE error IS NULL AND code = 1
UNION ALL SELECT doc_id, 0, 1 + used, n2, config, NULL FROM e WHERE error IS NULL AND code = 2
UNION ALL SELECT doc_id, 1, 1 + used + n2, len - 1 - used - n2, config, NULL FROM e WHERE error IS NULL AND code = 2)""")
def opus_packet_frames(spark, sf):
    """Documents of up to 1200 bytes as packets of one or two frames."""
    r = raw(spark, sf).filter((F.octet_length("b").between(1, 1200)) & (bits.byte_at("b", 0).bitwiseAND(3) != 3))
    return demux.explode(r, demux.opus_frames, demux.OPUS, "doc_id", "b")


@query(f"WITH {RAW} SELECT doc_id, CAST(k AS BIGINT) AS seq, CAST([0, 4, 1][k + 1] AS INTEGER) AS kind, CAST([8, 46, 50 + len][k + 1] AS BIGINT) AS start, CAST([34, len, doc_id % 100][k + 1] AS BIGINT) AS size, k = 2 AS last FROM raw, (VALUES (0), (1), (2)) s(k) WHERE len < 16777216")
def flac_block_chain(spark, sf):
    """A first block, a document, and padding."""
    r, n = raw(spark, sf), F.octet_length("b")
    size = lambda x: F.unhex(F.lpad(F.hex(x), 6, "0"))
    pad = F.col("doc_id") % 100
    f = F.concat(_hex(b"fLaC\x00\x00\x00\x22" + bytes(34) + b"\x04"), size(n), "b", _hex(b"\x81"), size(pad), F.unhex(F.repeat(F.lit("00"), pad.cast("int"))))
    return demux.explode(r.select("doc_id", f.alias("f")), demux.flac_blocks, demux.FLAC_BLOCKS, "doc_id", "f")


@query(f"WITH {RAW} SELECT doc_id, ['mp4', 'ogg', 'flac', 'wav', 'adts', 'ac3', 'mpeg', 'mpeg', 'unknown'][doc_id % 9 + 1] AS kind FROM raw")
def file_kinds(spark, sf):
    """Documents behind the first bytes of eight kinds of file."""
    heads = [b"\0\0\0\x18ftyp", b"OggS", b"fLaC", b"RIFF", b"\xff\xf1\x50\x80\x01\x5f\xfc\x00", b"\x0b\x77", b"ID3", b"\xff\xfb", b"\x00"]
    head = F.element_at(F.array(*[_hex(x) for x in heads]), (F.col("doc_id") % 9 + 1).cast("int"))
    return raw(spark, sf).select("doc_id", headers.sniff(F.concat(head, "b")).alias("kind"))


@query(f"WITH {RAW} SELECT doc_id, CAST(CASE WHEN doc_id % 3 = 0 THEN 10 + doc_id % 128 + 128 * ((doc_id // 128) % 128) ELSE 0 END AS BIGINT) AS audio_start, CAST(len + CASE WHEN doc_id % 3 = 0 THEN 10 ELSE 0 END + CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 125 END AS INTEGER) AS audio_end FROM raw")
def id3_bounds(spark, sf):
    """A leading tag's length in seven-bit bytes, and whether 128 bytes at the end are a tag."""
    d = F.col("doc_id")
    seven = lambda x: F.unhex(F.lpad(F.hex(x % 128), 2, "0"))
    tag = F.when(d % 3 == 0, F.concat(_hex(b"ID3\x04\x00\x00\x00\x00"), seven(F.floor(d / 128)), seven(d))).otherwise(F.unhex(F.lit("")))
    end = F.when(d % 2 == 0, _hex(b"TAG" + bytes(125))).otherwise(_hex(bytes(125)))
    f = F.concat(tag, "b", end)
    return raw(spark, sf).select("doc_id", bits.id3v2_size(f).alias("audio_start"), bits.audio_end(f).alias("audio_end"))


@query("""WITH e AS (SELECT event_id, ['mpeg1', 'mpeg2', 'mpeg25'][event_id % 3 + 1] AS v, 1 + event_id % 2 AS c, event_id % 8 AS a, ['nb', 'mb', 'wb', 'swb', 'fb'][event_id % 5 + 1] AS w, [120, 240, 480, 960][event_id % 4 + 1] AS n FROM events)
SELECT event_id, CAST(CASE WHEN v = 'mpeg1' AND c = 1 THEN 17 WHEN v = 'mpeg1' THEN 32 WHEN c = 1 THEN 9 ELSE 17 END AS INTEGER) AS side_size, CAST(CASE a WHEN 0 THEN 2 WHEN 7 THEN 8 ELSE a END AS INTEGER) AS channels, CAST(CASE w WHEN 'nb' THEN 8 WHEN 'mb' THEN 12 WHEN 'wb' THEN 16 END AS INTEGER) AS khz, CAST(CASE w WHEN 'nb' THEN 13 WHEN 'swb' THEN 19 WHEN 'fb' THEN 21 ELSE 17 END AS INTEGER) AS end_band, CAST(log2(n / 120) AS INTEGER) AS lm FROM e""")
def header_scalars(spark, sf):
    """Sizes and limits that follow from header fields alone."""
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("event_id") % len(xs) + 1).cast("int"))
    e = signals.table(spark, sf, "events").select("event_id", pick(["mpeg1", "mpeg2", "mpeg25"]).alias("v"), (1 + F.col("event_id") % 2).cast("int").alias("c"), (F.col("event_id") % 8).cast("int").alias("a"), pick(["nb", "mb", "wb", "swb", "fb"]).alias("w"), pick([120, 240, 480, 960]).alias("n"))
    return e.select("event_id", headers.side_info_size("v", "c").alias("side_size"), headers.aac_channels("a").alias("channels"), headers.silk_rate_khz("w").alias("khz"), headers.celt_end_band("w").alias("end_band"), headers.frame_size_lm("n").alias("lm"))
