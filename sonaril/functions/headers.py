"""Header fields of coded audio frames as struct columns; null where no valid header starts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sonaril.functions.bits import bit_field, bits_at, byte_at, sign_extend, unsigned_be, unsigned_le
from sonaril.functions.pcm import col

# Bit rates in bit/s by index (0 and 15 are not allowed), and sample rates.
L3_RATES = [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 0]
L2_RATES = [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384, 0]
LSF_RATES = [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160, 0]
SAMPLE_RATES = [44100, 48000, 32000]
# Bit rates in kbit/s of AC-3 by frame size code / 2.
AC3_KBPS = [32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384, 448, 512, 576, 640]
AAC_RATES = [96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350]


def _pick(values: list[int], i: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), i.cast("int"))


def mpeg_header(word: Column | str, layer: int = 3) -> Column:
    """Fields of a 32-bit header word of the given layer; null if the word is none."""
    w = col(word).cast("long")
    version, lay = bit_field(w, 19, 2), 4 - bit_field(w, 17, 2)
    br, sr, mode = bit_field(w, 12, 4), bit_field(w, 10, 2), bit_field(w, 6, 2)
    valid = (bit_field(w, 21, 11) == 0x7FF) & (version != 1) & (lay == layer) & (br != 0) & (br != 15) & (sr != 3)
    rates = F.when(version == 3, _pick(L2_RATES if layer == 2 else L3_RATES, br)).otherwise(_pick(LSF_RATES, br)) * 1000
    rate = (_pick(SAMPLE_RATES, sr) / F.when(version == 3, 1).when(version == 2, 2).otherwise(4)).cast("int")
    samples = F.lit(1152) if layer == 2 else F.when(version == 3, 1152).otherwise(576)
    length = F.floor(rates * F.when(samples == 1152, 144).otherwise(72) / rate) + bit_field(w, 9, 1)
    group = F.when(version == 3, 0).when(version == 2, 3).otherwise(6)
    return F.when(
        valid,
        F.struct(
            F.when(version == 3, "mpeg1").when(version == 2, "mpeg2").otherwise("mpeg25").alias("version"),
            lay.cast("int").alias("layer"),
            (1 - bit_field(w, 16, 1)).cast("int").alias("crc"),
            rates.cast("int").alias("bitrate"),
            rate.alias("sample_rate"),
            bit_field(w, 9, 1).cast("int").alias("padding"),
            mode.cast("int").alias("mode"),
            bit_field(w, 4, 2).cast("int").alias("mode_extension"),
            F.when(mode == 3, 1).otherwise(2).alias("channels"),
            samples.alias("samples"),
            length.cast("int").alias("frame_length"),
            (group + sr).cast("int").alias("band_table"),
        ),
    )


def side_info_size(version: Column | str, channels: Column | str) -> Column:
    v, c = col(version), col(channels)
    return F.when(v == "mpeg1", F.when(c == 1, 17).otherwise(32)).otherwise(F.when(c == 1, 9).otherwise(17))


def _side_layout(b: Column | str, mpeg1: bool, channels: int) -> Column:
    """Granules of one layout: every field stands at a fixed bit."""
    at = 0

    def take(n: int) -> Column:
        nonlocal at
        at += n
        return bits_at(b, at - n, n)

    back = take(9 if mpeg1 else 8)
    take((5 if channels == 1 else 3) if mpeg1 else channels)  # private bits
    shared = [F.array(*[take(1) if mpeg1 else F.lit(0) for _ in range(4)]) for _ in range(channels)]
    rows = []
    for gr in range(2 if mpeg1 else 1):
        for ch in range(channels):
            lengths = [take(n).alias(c) for c, n in (("part2_3_length", 12), ("big_values", 9), ("global_gain", 8), ("scalefac_compress", 4 if mpeg1 else 9))]
            switch, here = take(1), at
            kind, mixed = take(2), take(1)
            short_tables, gains = F.array(take(5), take(5)), F.array(take(3), take(3), take(3))
            at = here  # the same 22 bits have other fields where windows aren't switched
            tables, r0, r1 = F.array(take(5), take(5), take(5)), take(4), take(3)
            on = switch == 1
            region = F.when((kind == 2) & (mixed == 0), 8).otherwise(7)
            pick = lambda yes, no: F.when(on, yes).otherwise(no)  # noqa: B023, E731
            rows.append(
                F.struct(
                    back.alias("main_data_begin"), F.lit(gr).alias("gr"), F.lit(ch).alias("ch"), *lengths, switch.alias("win_switch"),
                    pick(kind, 0).alias("block_type"), pick(mixed, 0).alias("mixed"), pick(short_tables, tables).alias("table_select"), pick(gains, F.array(*[F.lit(0)] * 3)).alias("subblock_gain"),
                    pick(region, r0).alias("region0"), pick(20 - region, r1).alias("region1"),
                    (take(1) if mpeg1 else F.lit(0)).alias("preflag"), take(1).alias("scalefac_scale"), take(1).alias("count1table_select"), shared[ch].alias("scfsi"),
                )
            )
    return F.array(*rows)


def side_info(b: Column | str, mpeg1: Column, channels: Column) -> Column:
    """Layer III side information as an array with a struct for each granule and channel: a projection by the four layouts."""
    return F.when(mpeg1 & (channels == 1), _side_layout(b, True, 1)).when(mpeg1, _side_layout(b, True, 2)).when(channels == 1, _side_layout(b, False, 1)).otherwise(_side_layout(b, False, 2))


def layer2_table(bitrate: Column | str, channels: Column | str, rate: Column | str, lsf: Column | str) -> Column:
    """Allocation table of a layer II frame: 0-3 by kbit/s per channel and rate, 4 for half rates."""
    per = F.floor(col(bitrate) / (col(channels) * 1000))
    rate = col(rate)
    return (
        F.when(col(lsf), 4)
        .when(((rate == 48000) & (per >= 56)) | per.between(56, 80), 0)
        .when((rate != 48000) & (per >= 96), 1)
        .when((rate != 32000) & (per <= 48), 2)
        .otherwise(3)
    )


def opus_toc(toc: Column | str) -> Column:
    """Configuration, mode, bandwidth, frame size at 48 kHz, stereo flag and frame count code."""
    t = col(toc).cast("int")
    config = F.shiftright(t, 3).bitwiseAND(31)
    low = config.bitwiseAND(3)
    celt = F.element_at(F.array(F.lit(120), F.lit(240), F.lit(480), F.lit(960)), low + 1)
    silk = F.element_at(F.array(F.lit(480), F.lit(960), F.lit(1920), F.lit(2880)), low + 1)
    return F.struct(
        config.alias("config"),
        F.when(config < 12, "silk").when(config < 16, "hybrid").otherwise("celt").alias("mode"),
        F.when(config < 4, "nb").when(config < 8, "mb").when(config < 12, "wb").when(config < 14, "swb").when(config < 16, "fb").when(config < 20, "nb").when(config < 24, "wb").when(config < 28, "swb").otherwise("fb").alias("bandwidth"),
        F.when(config >= 16, celt).when(config >= 12, F.when(config % 2 == 1, 960).otherwise(480)).otherwise(silk).alias("frame_size"),
        (t.bitwiseAND(4) != 0).alias("stereo"),
        t.bitwiseAND(3).alias("code"),
    )


def ac3_frame_length(b: Column | str, at: int = 0) -> Column:
    """Length in bytes of the frame at an offset; null where none starts.

    A frame has 1536 samples: words = kbit/s * 96000 / rate, rounded down, at 44.1 kHz plus the code's last bit.
    """
    c4, c5 = byte_at(b, at + 4), byte_at(b, at + 5)
    rate, size = F.shiftright(c4, 6), c4.bitwiseAND(63)
    kbps = _pick(AC3_KBPS, F.shiftright(size, 1))
    words = F.when(rate == 0, kbps * 2).when(rate == 1, F.floor(kbps * 96000 / F.lit(44100)) + size % 2).otherwise(kbps * 3)
    fine = (byte_at(b, at) == 0x0B) & (byte_at(b, at + 1) == 0x77) & (rate != 3) & (size <= 37) & (F.shiftright(c5, 3) <= 10)
    return F.when(fine, words.cast("int") * 2)


def adts_header(b: Column | str, at: int = 0) -> Column:
    """Fields of an ADTS header at an offset; null where none starts."""
    c = [byte_at(b, at + k) for k in range(8)]
    return F.when(
        (c[0] == 0xFF) & (c[1].bitwiseAND(0xF6) == 0xF0) & c[7].isNotNull(),
        F.struct(
            F.shiftright(c[2], 2).bitwiseAND(15).alias("rate_index"),
            (c[2].bitwiseAND(1) * 4 + F.shiftright(c[3], 6)).alias("channel_config"),
            (c[3].bitwiseAND(3) * 2048 + c[4] * 8 + F.shiftright(c[5], 5)).alias("frame_length"),
            F.when(c[1].bitwiseAND(1) == 1, 7).otherwise(9).alias("header_length"),
            (F.shiftright(c[2], 6) + 1).alias("object_type"),
        ),
    )


def aac_channels(config: Column | str) -> Column:
    c = col(config)
    return F.when(c == 0, 2).when(c == 7, 8).otherwise(c)


def silk_rate_khz(bandwidth: Column | str) -> Column:
    b = col(bandwidth)
    return F.when(b == "nb", 8).when(b == "mb", 12).when(b == "wb", 16)


def celt_end_band(bandwidth: Column | str) -> Column:
    b = col(bandwidth)
    return F.when(b == "nb", 13).when(b.isin("mb", "wb"), 17).when(b == "swb", 19).when(b == "fb", 21)


def frame_size_lm(frame_size: Column | str) -> Column:
    """log2 of a frame's size in units of 120 samples."""
    n = col(frame_size)
    return F.when(n == 120, 0).when(n == 240, 1).when(n == 480, 2).when(n == 960, 3)


def _starts(b: Column | str, magic: bytes) -> Column:
    return F.substring(col(b), 1, len(magic)) == F.unhex(F.lit(magic.hex()))


def opus_head(b: Column | str) -> Column:
    """Fields of an identification packet; null if the packet is none."""
    gain = sign_extend(unsigned_le(b, 16, 2), 16).cast("int")
    fields = F.struct(byte_at(b, 8).alias("version"), byte_at(b, 9).alias("channels"), unsigned_le(b, 10, 2).cast("int").alias("pre_skip"), unsigned_le(b, 12, 4).alias("input_rate"), gain.alias("output_gain"), byte_at(b, 18).alias("mapping_family"))
    return F.when((F.octet_length(col(b)) >= 19) & _starts(b, b"OpusHead"), fields)


def vorbis_identification(b: Column | str) -> Column:
    """Fields of an identification header; null if it is none, or one that no stream may have."""
    sizes = byte_at(b, 28)
    short, long_ = (F.call_function("shiftleft", F.lit(1), x.cast("int")) for x in (sizes.bitwiseAND(15), F.shiftright(sizes, 4)))
    fine = (F.octet_length(col(b)) >= 30) & _starts(b, b"\x01vorbis") & (unsigned_le(b, 7, 4) == 0) & (byte_at(b, 11) > 0) & (unsigned_le(b, 12, 4) > 0)
    fine = fine & short.between(64, 8192) & long_.between(64, 8192) & (short <= long_) & (byte_at(b, 29) % 2 == 1)
    rate = lambda at: sign_extend(unsigned_le(b, at, 4), 32)
    fields = F.struct(byte_at(b, 11).alias("channels"), unsigned_le(b, 12, 4).alias("rate"), rate(16).alias("most"), rate(20).alias("nominal"), rate(24).alias("least"), short.alias("short_block"), long_.alias("long_block"))
    return F.when(fine, fields)


def vorbis_block_size(packet: Column | str, modes: list[bool], short: Column | int, long_: Column | int) -> Column:
    """Block size of an audio packet by its mode number, 0 for a packet of another kind; ``modes`` says which modes are long."""
    first = byte_at(packet, 0)
    wide = max(len(modes) - 1, 0).bit_length()
    mode = F.shiftright(first, 1).bitwiseAND((1 << wide) - 1)
    is_long = F.get(F.array(*map(F.lit, modes)), mode)
    size = F.when(is_long, F.lit(long_) if isinstance(long_, int) else long_).otherwise(F.lit(short) if isinstance(short, int) else short)
    return F.when((first % 2 == 0) & is_long.isNotNull(), size).otherwise(0)


def flac_streaminfo(b: Column | str) -> Column:
    """Fields of a native stream's first block; null if there is none of 34 bytes, or it names no valid depth."""
    packed = unsigned_be(b, 18, 4)  # 20 bits of rate, 3 of channels, 5 of depth, 4 of the length
    depth = bit_field(packed, 4, 5) + 1
    digest = F.lower(F.hex(F.substring(col(b), 27, 16)))
    fields = F.struct(
        *(unsigned_be(b, at, n).alias(name) for name, at, n in (("min_block", 8, 2), ("max_block", 10, 2), ("min_frame", 12, 3), ("max_frame", 15, 3))),
        bit_field(packed, 12, 20).alias("sample_rate"),
        (bit_field(packed, 9, 3) + 1).alias("channels"),
        depth.alias("bits"),
        (bit_field(packed, 0, 4) * F.lit(1 << 32) + unsigned_be(b, 22, 4)).alias("total_samples"),
        F.when(digest != "0" * 32, digest).alias("md5"),
    )
    return F.when((F.octet_length(col(b)) >= 42) & _starts(b, b"fLaC") & (byte_at(b, 4).bitwiseAND(127) == 0) & (unsigned_be(b, 5, 3) == 34) & (depth >= 4), fields)


def vbr_tag(frame: Column | str, version: Column | str, channels: Column | str) -> Column:
    """Whether a layer III frame is a variable-rate tag and no audio: a name after its side information, or at byte 36."""
    at = 5 + side_info_size(version, channels)
    after = F.substring(col(frame), at, F.lit(4))
    return after.isin(F.unhex(F.lit(b"Xing".hex())), F.unhex(F.lit(b"Info".hex()))) | (F.substring(col(frame), 37, 4) == F.unhex(F.lit(b"VBRI".hex())))


def audio_config(b: Column | str) -> Column:
    """Object type, rate index and channel configuration of an AudioSpecificConfig."""
    c = [F.coalesce(byte_at(b, k), F.lit(0)) for k in range(7)]
    word = lambda at: c[at].cast("long") * 65536 + c[at + 1] * 256 + c[at + 2]
    short = bit_field(word(0), 19, 5)
    wide = short == 31
    kind = F.when(wide, 32 + bit_field(word(0), 13, 6)).otherwise(short)
    rate = F.when(wide, bit_field(word(1), 17, 4)).otherwise(bit_field(word(0), 15, 4))
    # a rate of 15 is spelled out in 24 bits, which push the channels on by three bytes
    plain = F.when(wide, bit_field(word(1), 13, 4)).otherwise(bit_field(word(0), 11, 4))
    far = F.when(wide, bit_field(word(4), 13, 4)).otherwise(bit_field(word(3), 11, 4))
    return F.struct(kind.cast("int").alias("object_type"), rate.cast("int").alias("rate_index"), F.when(rate == 15, far).otherwise(plain).cast("int").alias("channel_config"))


def sniff(content: Column | str) -> Column:
    """Container or codec of a file by its first bytes."""
    c = col(content)
    ascii_ = lambda at, n: F.decode(F.substring(c, at, n), "iso-8859-1")
    return (
        F.when(ascii_(5, 4) == "ftyp", "mp4")
        .when(ascii_(1, 4) == "OggS", "ogg")
        .when(ascii_(1, 4) == "fLaC", "flac")
        .when(ascii_(1, 4) == "RIFF", "wav")
        .when(adts_header(c).isNotNull(), "adts")
        .when((byte_at(c, 0) == 0x0B) & (byte_at(c, 1) == 0x77), "ac3")
        .when((ascii_(1, 3) == "ID3") | ((byte_at(c, 0) == 0xFF) & (byte_at(c, 1) >= 0xE0)), "mpeg")
        .otherwise("unknown")
    )
