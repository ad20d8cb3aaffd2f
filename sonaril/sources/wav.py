"""RIFF/WAVE as a Python data source: one file per stream on write, block rows on read."""

from __future__ import annotations

import struct
import uuid
from urllib.parse import quote, unquote

from pyarrow import fs

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "stream_id string, channels int, sample_rate int, samples array<short>"


def wav_bytes(samples, channels: int, rate: int) -> bytes:
    """44-byte header and little-endian 16-bit samples."""
    body = struct.pack(f"<{len(samples)}h", *samples)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(body), b"WAVE", b"fmt ", 16, 1, channels, rate, rate * channels * 2, channels * 2, 16, b"data", len(body)) + body


def parse_wav(b: bytes) -> tuple[int, int, list[int]]:
    """(channels, rate, samples); chunks other than the format and the data are skipped."""
    at, channels, rate, data = 12, 1, 8000, b""
    while at + 8 <= len(b):
        name, size = struct.unpack_from("<4sI", b, at)
        if name == b"fmt ":
            channels, rate = struct.unpack_from("<HI", b, at + 10)
        elif name == b"data":
            data = b[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    return channels, rate, list(struct.unpack(f"<{len(data) // 2}h", data[: len(data) // 2 * 2]))


class _File(InputPartition):
    def __init__(self, name: str):
        self.name = name


class _Folder:
    """A folder of any file system that pyarrow reaches by its address (a plain path is a local one)."""

    def __init__(self, address: str):
        self.address = address

    def open(self) -> tuple[fs.FileSystem, str]:
        system, path = fs.FileSystem.from_uri(self.address)
        return system, path.rstrip("/")


class _Reader(DataSourceReader):
    def __init__(self, folder: _Folder):
        self.folder = folder

    def partitions(self):
        system, path = self.folder.open()
        return [_File(f.base_name) for f in sorted(system.get_file_info(fs.FileSelector(path)), key=lambda f: f.path) if f.is_file and f.base_name.endswith(".wav")]

    def read(self, partition):
        system, path = self.folder.open()
        with system.open_input_stream(f"{path}/{partition.name}") as f:
            channels, rate, samples = parse_wav(f.read())
        yield unquote(partition.name[:-4]), channels, rate, samples


class _Written(WriterCommitMessage):
    def __init__(self, names: list[tuple[str, str]]):
        self.names = names


class _Writer(DataSourceWriter):
    """Tasks write hidden files; the commit renames those of the attempts that succeeded."""

    def __init__(self, folder: _Folder):
        self.folder = folder

    def write(self, rows):
        system, path = self.folder.open()
        system.create_dir(path, recursive=True)
        out = []
        for r in rows:
            name = f"{quote(str(r.stream_id), safe='')}.wav"
            temp = f".{uuid.uuid4().hex}.tmp"
            with system.open_output_stream(f"{path}/{temp}") as f:
                f.write(wav_bytes(r.samples, r.channels, r.sample_rate))
            out.append((temp, name))
        return _Written(out)

    def commit(self, messages):
        system, path = self.folder.open()
        for m in messages:
            for temp, name in m.names if m else []:
                system.move(f"{path}/{temp}", f"{path}/{name}")

    def abort(self, messages):
        system, path = self.folder.open()
        for m in messages:
            for temp, _ in m.names if m else []:
                if system.get_file_info(f"{path}/{temp}").is_file:
                    system.delete_file(f"{path}/{temp}")


class WavDataSource(DataSource):
    """``spark.read/write.format("wav")``; the path must be one that all executors reach."""

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Reader(_Folder(self.options["path"]))

    def writer(self, schema, overwrite):
        return _Writer(_Folder(self.options["path"]))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WavDataSource)


def blocks(df: DataFrame, rate: int, most: int = 1 << 22) -> DataFrame:
    """Long mono rows (stream_id, n, s) to rows for the sink: a stream of more than ``most`` samples becomes files of so many, numbered ``-1`` and on."""
    part = F.floor(F.col("n") / most)
    name = F.when(part == 0, F.col("stream_id")).otherwise(F.concat("stream_id", F.lit("-"), part.cast("string")))
    g = df.groupBy(name.alias("stream_id")).agg(F.array_sort(F.collect_list(F.struct("n", "s"))).alias("p"))
    return g.select("stream_id", F.lit(1).alias("channels"), F.lit(rate).alias("sample_rate"), F.transform("p", lambda x: x["s"].cast("short")).alias("samples"))
