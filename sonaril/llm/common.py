"""Shared pieces: scratch tables, Arrow chunking and vectorised word hashing."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sonaril.session import shared_folder

#: Bytes of text that a numpy kernel handles at once; bounds a task's memory whatever the batch size is.
CHUNK_BYTES = 1 << 19


# --------------------------------------------------------------------------- scratch tables
class Scratch:
    """Tables of one operator call in the shared folder; ``drop`` frees those no longer needed."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` (cutting its lineage) and return a reader of the written rows."""
        path = f"{self.base}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def crc_text(col: Column | str) -> Column:
    """crc32 of a column's text; null counts as the empty text."""
    c = F.col(col) if isinstance(col, str) else col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --------------------------------------------------------------------------- Arrow helpers
def text_buffer(arr) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and the n+1 offsets of its values; null is the empty text."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    kind = pa.large_binary() if pa.types.is_binary(arr.type) or pa.types.is_large_binary(arr.type) else pa.large_string()
    arr = arr.cast(kind)
    if arr.null_count:
        arr = arr.fill_null(b"" if kind == pa.large_binary() else "")
    n = len(arr)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bufs = arr.buffers()
    offs = np.frombuffer(bufs[1], np.int64)[arr.offset : arr.offset + n + 1]
    data = np.frombuffer(bufs[2], np.uint8)[offs[0] : offs[-1]] if bufs[2] is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def text_chunks(batch: pa.RecordBatch, col: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch of about ``limit`` text bytes each (a longer text alone), with their bytes and offsets."""
    data, offs = text_buffer(batch.column(batch.schema.get_field_index(col)))
    n, i = batch.num_rows, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield batch.slice(i, j - i), data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


# --------------------------------------------------------------------------- hashing
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_pow: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64; kept per worker, grown by doubling."""
    if len(_pow[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for k, b in enumerate((_BASE, _INV)):
            a = np.full(size, b, np.uint64)
            a[0] = 1
            _pow[k] = np.multiply.accumulate(a)
    return _pow[0][:n], _pow[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """S[i] = sum over k < i of (byte_k + 1) * base**k; any substring's hash follows from two entries."""
    p, _ = _powers(len(data) + 1)
    s = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=s[1:])
    return s


def span_hash(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the substrings [start, end), the same wherever the substring stands."""
    _, q = _powers(len(s))
    return mix((s[end] - s[start]) * q[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes other than 0x20 and 0x09-0x0D: start, end and document index of each, in order."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    inside = ~space
    start = np.flatnonzero(inside & (edge[:-1] | np.concatenate(([True], space[:-1])))) if len(data) else np.zeros(0, np.int64)
    end = np.flatnonzero(inside & (edge[1:] | np.concatenate((space[1:], [True])))) + 1 if len(data) else np.zeros(0, np.int64)
    doc = np.searchsorted(offs, start, side="right") - 1
    return start, end, doc


def word_hashes(data: np.ndarray, offs: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document index of every word."""
    if lower:
        data = lower_ascii(data)
    start, end, doc = words(data, offs)
    return span_hash(prefix_hash(data), start, end), doc


def long_word_hashes(data: np.ndarray, offs: np.ndarray, bounds: bool = False, size: int = CHUNK_BYTES):
    """Hash of every word and the texts' n + 1 offsets into them (``bounds``: and each word's first byte and end).

    Goes by blocks of about ``size`` bytes that end between words, so that a very long text takes no more than its words.
    """
    parts, lo = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
    while lo < len(data):
        hi = min(lo + size, len(data))
        while hi < len(data):
            gap = np.flatnonzero((data[lo:hi] == 32) | ((data[lo:hi] >= 9) & (data[lo:hi] <= 13)))
            if len(gap):
                hi = lo + int(gap[-1]) + 1
                break
            hi = min(hi + size, len(data))  # a word longer than a block
        part = data[lo:hi]
        inner = np.concatenate(([0], offs[(offs > lo) & (offs < hi)] - lo, [hi - lo]))
        start, end, _ = words(part, inner)
        parts.append((span_hash(prefix_hash(part), start, end), start + lo, end + lo))
        lo = hi
    h, start, end = (np.concatenate(x) for x in zip(*parts, strict=True))
    at = np.searchsorted(start, offs)
    return (h, at, start, end) if bounds else (h, at)


_SHINGLE = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def shingle_hashes(wh: np.ndarray, doc: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words and their documents; a shorter text is one shingle of all its words."""
    n = len(wh)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    comb = wh * _SHINGLE[0]
    for i in range(1, min(width, n)):
        same = doc[i:] == doc[:-i]
        comb[:-i] += np.where(same, wh[i:] * _SHINGLE[i], np.uint64(0))
    full = np.zeros(n, bool)
    if n >= width:
        full[: n - width + 1] = doc[width - 1 :] == doc[: n - width + 1]
    first = np.concatenate(([True], doc[1:] != doc[:-1]))
    keep = full | first  # the first word's entry holds all words of a text shorter than the width
    return mix(comb[keep]), doc[keep]


def doc_slices(doc: np.ndarray, n_docs: int) -> np.ndarray:
    """n_docs + 1 offsets of each document's run in a sorted index array."""
    return np.searchsorted(doc, np.arange(n_docs + 1))


#: what workers keep from task to task, by operator: how to drop it
CACHES: dict[str, Callable[[], None]] = {}


def tidy(owner: str | None = None) -> None:
    """Drop what other operators have kept in this worker, and give freed memory back to the system."""
    for name, drop in CACHES.items():
        if name != owner:
            drop()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the C library that has it
        pass


def tidied(run, owner: str | None = None):
    """A task function over batches that leaves no memory behind but its operator's cache."""

    def task(batches):
        tidy(owner)
        try:
            yield from run(batches)
        finally:
            tidy(owner)

    return task


def map_arrow(df: DataFrame, kernel, schema: str, owner: str | None = None) -> DataFrame:
    """``mapInArrow`` of a kernel that takes one record batch and yields record batches; ``owner`` names a cache that it keeps."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield from kernel(b)

    return df.mapInArrow(tidied(run, owner), schema)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like the wanted ones that ``df`` doesn't have yet (names are compared as Spark does, without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
