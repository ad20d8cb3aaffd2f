"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A fingerprint holds the k smallest distinct 64-bit hashes of a text's five-word shingles (words:
ASCII-lower-cased runs other than white space), as base64 of little-endian unsigned integers in
ascending order. Sketches of parts merge into the sketch of the whole; two sketches estimate
resemblance and containment, one the number of distinct shingles (exactly, when it has fewer than k).

Edges: null text is the empty text and has the empty fingerprint; a text of one to four words is one
shingle; equal texts have equal fingerprints, and two empty fingerprints have likeness 1.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonaril.llm.common import CHUNK_BYTES, doc_slices, map_arrow, shingle_hashes, shuffle_partitions, text_buffer, text_chunks, word_hashes

K = 128
WIDTH = 5


# --------------------------------------------------------------------------- one sketch
def bottom_k(h: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest distinct hashes, ascending."""
    if len(h) > 4 * k:  # most hashes can't be among them; repeated ones may need a wider cut
        cut = 2 * k
        while cut < len(h):
            low = np.unique(np.partition(h, cut)[: cut + 1])
            if len(low) > k:
                return low[:k]
            cut *= 4
    return np.unique(h)[:k]


def sketch_texts(data: np.ndarray, offs: np.ndarray, k: int = K, width: int = WIDTH) -> list[np.ndarray]:
    n = len(offs) - 1
    h, doc = shingle_hashes(*word_hashes(data, offs), width)
    at = doc_slices(doc, n)
    return [bottom_k(h[at[i] : at[i + 1]], k) for i in range(n)]


def encode(s: np.ndarray) -> str:
    return base64.b64encode(s.astype("<u8").tobytes()).decode()


def decode(s: str | None) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s or ""), "<u8")


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard likeness: the shared part of the k smallest hashes of the union."""
    if not len(a) and not len(b):
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    # a sketch of k hashes says nothing beyond its last one
    union = np.union1d(a, b)[:k]
    return float(len(np.intersect1d(np.intersect1d(a, b, assume_unique=True), union, assume_unique=True)) / len(union))


def distinct_count(s: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(s)) if len(s) < k else (k - 1) * 2.0**64 / (float(s[-1]) + 1.0)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has too, from the resemblance and the two counts."""
    if not len(a):
        return 1.0
    if len(a) < k and len(b) < k:
        return float(np.isin(a, b).sum() / len(a))
    union = np.union1d(a, b)[:k]
    shared = len(np.intersect1d(np.intersect1d(a, b, assume_unique=True), union, assume_unique=True))
    mine = len(np.intersect1d(a, union, assume_unique=True))
    return float(shared / mine) if mine else 0.0


# --------------------------------------------------------------------------- DataFrame forms
def fingerprint(df: DataFrame, text_col: str = "text", out: str = "fingerprint", k: int = K) -> DataFrame:
    """``df`` with a fingerprint column; no shuffle."""

    def kernel(batch: pa.RecordBatch):
        for part, data, offs in text_chunks(batch, text_col):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([encode(s) for s in sketch_texts(data, offs, k)], pa.string())], names=[*part.schema.names, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != out)
    return map_arrow(df.drop(out), kernel, f"{fields}, `{out}` string")


def merge(df: DataFrame, key: str, fp_col: str = "fingerprint", k: int = K) -> DataFrame:
    """(key, fingerprint) of the union of each key's parts.

    Each task first merges its own rows of a key, so a hot key sends one sketch per task.
    """
    kind = df.schema[key].dataType.simpleString()

    def per_task(frames: Iterator[pd.DataFrame]):
        held: dict = {}
        for pdf in frames:
            for key_, fp in zip(pdf[key], pdf[fp_col], strict=True):
                key_ = None if key_ is None or key_ != key_ else key_
                new = decode(fp)
                held[key_] = np.union1d(held[key_], new)[:k] if key_ in held else new
            if len(held) > 100_000:
                yield pd.DataFrame({key: list(held), fp_col: [encode(s) for s in held.values()]})
                held = {}
        if held:
            yield pd.DataFrame({key: list(held), fp_col: [encode(s) for s in held.values()]})

    def union(pdf: pd.DataFrame) -> pd.DataFrame:
        s = np.unique(np.concatenate([decode(x) for x in pdf[fp_col]]))[:k]
        return pd.DataFrame({key: pdf[key].iloc[:1], fp_col: [encode(s)]})

    schema = f"`{key}` {kind}, `{fp_col}` string"
    return df.select(key, fp_col).mapInPandas(per_task, schema).groupBy(key).applyInPandas(union, schema)


# --------------------------------------------------------------------------- each document beside its successor
_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _with_next(batches):
    """Rows sorted by (bucket, doc_id, text), each bucket ending in a flagged copy of its successor's first rows."""
    pend: list[tuple] = []  # (bucket, doc_id, text) of the last row, still without its successor
    rows: list[tuple] = []  # (doc_id, text, next text)
    held = 0
    for b in batches:
        for bucket, doc_id, copy, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            text = text or ""
            if pend and pend[0][0] == bucket:
                rows.append((pend[0][1], pend[0][2], text))
                held += len(pend[0][2]) + len(text)
                pend = []
            if not copy:
                pend = [(bucket, doc_id, text)]
            if held > CHUNK_BYTES:
                yield from _compare(rows)
                rows, held = [], 0
    if rows:
        yield from _compare(rows)


def _compare(rows: list[tuple]):
    texts = [r[1] for r in rows]
    after = [r[2] for r in rows]
    edited = []
    for t, n in zip(texts, after, strict=True):
        m = len(t) // 4
        edited.append(t[: len(t) - m] + n[:m])
    a, e = (sketch_texts(*text_buffer(pa.array(x, pa.large_string()))) for x in (texts, edited))
    # in a run of successors the next document's sketch is the next row's own
    follows = [i + 1 < len(rows) and after[i] is texts[i + 1] for i in range(len(rows))]
    rest = [i for i, f in enumerate(follows) if not f]
    own = dict(zip(rest, sketch_texts(*text_buffer(pa.array([after[i] for i in rest], pa.large_string()))), strict=True))
    nxt = [a[i + 1] if f else own[i] for i, f in enumerate(follows)]
    cols = [
        pa.array([r[0] for r in rows], pa.int64()),
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
        pa.array([encode(s) for s in a]),
        pa.array([encode(s) for s in e]),
        pa.array([resemblance(x, y) for x, y in zip(a, e, strict=True)], pa.float64()),
        pa.array([resemblance(x, y) for x, y in zip(a, nxt, strict=True)], pa.float64()),
    ]
    yield pa.RecordBatch.from_arrays(cols, names=[f.split()[0] for f in _SCHEMA.split(", ")])


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text (its last quarter replaced by the next document's start).

    The next document is the next by ascending doc_id (null ids first; equal ids in order of their
    texts), after the last the first. Documents go once to sorted buckets of neighbouring ids; the
    first document of a bucket also goes, flagged, to the end of the bucket before it.
    """
    spark = docs.sparkSession
    p = shuffle_partitions(spark)
    lowest = -(1 << 63)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest))
    ids = docs.select(key.alias("key"))
    cuts = ids.agg(F.percentile_approx("key", [i / p for i in range(1, p)] or [0.5], 100 * p)).first()[0]  # p - 1 numbers
    cuts = sorted({int(c) for c in cuts or []})
    bucket = F.lit(0)
    if cuts:
        bounds = F.array(*[F.lit(c).cast("long") for c in cuts])
        bucket = F.array_size(F.filter(bounds, lambda c: c <= F.col("key")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), "text").withColumn("bucket", bucket.cast("int"))
    firsts = sorted((r["bucket"], r["first"]) for r in rows.groupBy("bucket").agg(F.min("key").alias("first")).collect())  # one row per bucket, p at most
    if not firsts:
        return spark.createDataFrame([], _SCHEMA)
    # the bucket that each bucket's first document is also sent to, and the place it has there
    before = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}
    copies = F.create_map(*[x for first, b in before.items() for x in (F.lit(first).cast("long"), F.lit(b))])
    sent = F.array_compact(F.array(F.struct(F.col("bucket"), F.lit(False).alias("copy")), F.when(copies[F.col("key")].isNotNull(), F.struct(copies[F.col("key")].alias("bucket"), F.lit(True).alias("copy")))))
    dealt = (
        rows.withColumn("sent", F.explode(sent))
        .select(F.col("sent.bucket").alias("bucket"), "doc_id", F.col("sent.copy").alias("copy"), "text", "key")
        .repartitionById(p, F.col("bucket"))
        .sortWithinPartitions("bucket", "copy", "key", F.coalesce("text", F.lit("")))
        .select("bucket", "doc_id", "copy", "text")
    )
    return dealt.mapInArrow(_with_next, _SCHEMA)
