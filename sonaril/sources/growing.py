"""A stream of bytes pushed into files: what growing container files have gained, and their packets.

``spark.readStream.format("growing")`` reads the files of a folder; an offset is how many bytes of each
file have been read, so a query goes on where its checkpoint says, whatever has been appended since. Rows
are pieces (name, start, body) of at most ``piece`` bytes. Files only grow (one that shrinks fails); an offset
lists every file, so finished files should leave the folder now and then.

``ogg_packet_stream`` puts the pieces of a file together and yields each packet of its first logical stream once it is
complete. Its state is what no page end has been seen for yet: less than a page, the packet that goes on over pages,
and pieces that came before their turn (at most ``WAITING``, beyond which the query fails).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PIECE = 1 << 20
WAITING = 4096


class _Range(InputPartition):
    def __init__(self, name: str, start: int, stop: int):
        self.name, self.start, self.stop = name, start, stop


class _Reader(DataSourceStreamReader):
    def __init__(self, address: str, ending: str, piece: int):
        self.address, self.ending, self.piece = address, ending, piece

    def _open(self) -> tuple[fs.FileSystem, str]:
        system, path = fs.FileSystem.from_uri(self.address)
        return system, path.rstrip("/")

    def initialOffset(self) -> dict:
        return {"sizes": {}}

    def latestOffset(self) -> dict:
        system, path = self._open()
        found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
        return {"sizes": {f.base_name: f.size for f in sorted(found, key=lambda f: f.base_name) if f.is_file and f.base_name.endswith(self.ending) and f.size and not f.base_name.startswith((".", "_"))}}

    def partitions(self, start: dict, end: dict):
        out = []
        for name, stop in end["sizes"].items():
            at = start["sizes"].get(name, 0)
            if stop < at:
                raise ValueError(f"{name} has shrunk from {at} to {stop} bytes")
            while at < stop:
                out.append(_Range(name, at, min(at + self.piece, stop)))
                at += self.piece
        return out

    def read(self, partition: _Range) -> Iterator[tuple]:
        system, path = self._open()
        with system.open_input_file(f"{path}/{partition.name}") as f:
            body = f.read_at(partition.stop - partition.start, partition.start)
        if len(body) != partition.stop - partition.start:
            raise ValueError(f"{partition.name} has fewer bytes than the {partition.stop} seen before")
        yield partition.name, partition.start, body

    def commit(self, end: dict) -> None:
        pass


class GrowingDataSource(DataSource):
    """Options: path (an address that all executors reach), ending (of file names), piece (most bytes a row)."""

    @classmethod
    def name(cls) -> str:
        return "growing"

    def schema(self) -> str:
        return "name string, start long, body binary"

    def streamReader(self, schema):
        return _Reader(self.options["path"], self.options.get("ending", ""), int(self.options.get("piece", PIECE)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GrowingDataSource)


# --------------------------------------------------------------------------- packets
class PageState:
    """Whole packets of a growing file: bytes go in at their place, packets come out in order, each once."""

    def __init__(self):
        self.at, self.rest, self.early, self.serial, self.open, self.count = 0, b"", {}, None, b"", 0

    def push(self, start: int, body: bytes) -> list[tuple[int, bytes]]:
        from sonaril.sources.demux import ogg_fragments

        if start + len(body) <= self.at:
            return []  # seen before
        if start < self.at:
            start, body = self.at, body[self.at - start :]
        self.early[start] = body
        if len(self.early) > WAITING:
            raise ValueError(f"byte {self.at} is missing, and {len(self.early)} later pieces wait for it")
        while self.at in self.early:
            got = self.early.pop(self.at)
            self.rest, self.at = self.rest + got, self.at + len(got)
        out, used = [], 0
        while (size := whole_page(self.rest, used)) is not None:
            for serial, _, _, _, _, complete, data in ogg_fragments(self.rest[used : used + size]):
                self.serial = serial if self.serial is None else self.serial
                if serial == self.serial:
                    self.open += data
                    if complete:
                        out.append((self.count, self.open))
                        self.open, self.count = b"", self.count + 1
            used += size
        self.rest = self.rest[used:]
        return out


def whole_page(b: bytes, at: int) -> int | None:
    """Size of the page at ``at``; None where it isn't whole yet."""
    if len(b) < at + 27:
        return None
    if b[at : at + 4] != b"OggS":
        raise ValueError("no page where one should begin")
    n = b[at + 26]
    if len(b) < at + 27 + n:
        return None
    size = 27 + n + sum(b[at + 27 : at + 27 + n])
    return size if len(b) >= at + size else None


class _Packets(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "data binary")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        st = PageState()
        if self.state.exists():
            st.__dict__.update(pickle.loads(bytes(self.state.get()[0])))
        out = []
        for frame in rows:
            for r in frame.sort_values("start").itertuples():
                out += st.push(int(r.start), bytes(r.body))
        self.state.update((pickle.dumps(st.__dict__),))
        yield pd.DataFrame({"name": pd.Series([key[0]] * len(out), dtype=object), "packet_no": pd.Series([n for n, _ in out], dtype="int64"), "payload": pd.Series([p for _, p in out], dtype=object)})


def ogg_packet_stream(pieces: DataFrame) -> DataFrame:
    """Streaming (name, start, body) -> (name, packet_no, payload)."""
    return pieces.groupBy("name").transformWithStateInPandas(_Packets(), "name string, packet_no long, payload binary", "append", "None")


# --------------------------------------------------------------------------- functions for SQL
def register_walks(spark: SparkSession) -> None:
    """Container walks as table functions of a payload, for ``FROM files, LATERAL ogg_fragments(content)``."""
    from pyspark.sql.functions import udtf

    from sonaril.sources import demux

    walks = {
        "ogg_fragments": (demux.ogg_fragments, demux.OGG),
        "mp4_boxes": (demux.mp4_boxes, demux.BOXES),
        "adts_frames": (demux.adts_frames, demux.FRAMES),
        "ac3_frames": (demux.ac3_frames, demux.FRAMES),
        "mpeg_frames": (demux.mpeg_frames, demux.FRAMES),
    }
    for name, (walk, schema) in walks.items():
        spark.udtf.register(name, udtf(_walker(walk), returnType=f"seq long, {schema}"))


def _walker(walk):
    class Walk:
        def eval(self, payload: bytes):
            for i, item in enumerate(walk(payload or b"")):
                yield (i, *item)

    return Walk
