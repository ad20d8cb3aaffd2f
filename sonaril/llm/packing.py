"""Packing along a space-filling curve.

Every document's hashed bag of ids is projected to ``DIMS`` numbers (each id's hash gives its signs
and sizes), scaled to the unit sphere and turned into a Hilbert key. Documents are sorted by
that key, so neighbours on the curve are alike; their ids are laid end to end along the curve and
cut every ``length`` ids. The last, partial sequence is cut at powers of two, so nothing is padded.

Copies share a key; a hash of the id in its low bits splits such groups over partitions.

Edges: null text is the empty text (its ids are the end id alone); rows with equal keys follow
doc_id and then their ids; repeated rows are packed as rows of their own; an empty table gives none.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonaril.llm.common import CACHES, Scratch, crc_text, map_arrow, mix, shuffle_partitions, text_chunks

DIMS, BITS = 4, 12
LENGTH, END_ID = 4096, 2
#: words whose ids a worker keeps (it grows by some 150 MB on the check's documents); beyond that it starts anew
_CACHE = 600_000


# --------------------------------------------------------------------------- Hilbert keys
def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index along the Hilbert curve of points with integer coordinates below 2**bits (columns)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    one = np.int64(1)
    q = one << np.int64(bits - 1)
    while q > 1:  # undo the rotations and reflections of every level, coarsest first
        for i in range(n):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(up, q - 1, swap)
            x[i] ^= swap
        q >>= one
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = one << np.int64(bits - 1)
    while q > 1:
        flip = np.where((x[n - 1] & q) != 0, flip ^ (q - 1), flip)
        q >>= one
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << one) | ((x[i] >> np.int64(b)) & one)
    return key


def curve_keys(ids: np.ndarray, at: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Hilbert key of every document's summed id vectors; ``at``: n + 1 offsets into the ids, no document empty."""
    v = np.add.reduceat(table[ids], at[:-1], axis=0)
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    unit = np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)
    return hilbert(np.minimum(((unit + 1) * (1 << (BITS - 1))).astype(np.int64), (1 << BITS) - 1))


def projection(vocab: int) -> np.ndarray:
    """Each id's hashed vector in ``DIMS`` dimensions."""
    h = mix(np.arange(1, vocab + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.stack([((h >> np.uint64(16 * d)) & np.uint64(0xFFFF)).astype(np.float64) - 32767.5 for d in range(DIMS)], 1)


# --------------------------------------------------------------------------- ids
#: White space that text.split() takes but the tokenizer's pattern may not; such texts go through the tokenizer whole.
_ODD_ASCII = tuple(map(chr, range(0x1C, 0x20)))
_ODD_SPACE = re.compile("[%s]" % "".join(map(chr, [*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF])))


def _byte_chars() -> list[str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for 256 and up, in order."""
    out, more = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b:
            out.append(chr(b))
        else:
            out.append(chr(more))
            more += 1
    return out


#: by byte, where the two differ
_BYTE_CHARS = {b: c for b, c in enumerate(_byte_chars()) if chr(b) != c}
#: Latin letters; these ranges hold nothing else
_LATIN = re.compile("[a-zªµºß-öø-\u024f]+")


def normalised(t: str) -> str:
    """NFC and lower case as the tokenizer's file has it: letter by letter, so a last sigma is like any other."""
    if t.isascii():
        return t.lower()
    t = unicodedata.normalize("NFC", t)
    return "".join([c.lower() for c in t]) if "Σ" in t else t.lower()


class WordIds(dict):
    """Ids of texts by a word-level BPE tokenizer: white space always ends a word, so each word's ids are kept.

    Keys are runs of characters without white space and the words in them, normalised; a word has the same ids
    in both roles. Values are ids as bytes of ``dtype``.
    """

    def __init__(self, path: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model  # taken once: every reading of the attribute wraps it anew
        self.dtype, self.code = (np.uint16, "H") if self.tok.get_vocab_size() <= 1 << 16 else (np.uint32, "I")
        # the tokenizer's own word pattern (a fixed value of its file)
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.table = projection(max(self.tok.get_vocab_size(), 1 << 16))

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tok.encode_batch(texts, add_special_tokens=False)]

    def __missing__(self, u: str) -> bytes:
        head = u[:-1]
        if u.isalpha() if u.isascii() else _LATIN.fullmatch(u):
            got = self._word(u)
        elif u[-1].isascii() and (head.isalpha() if head.isascii() else _LATIN.fullmatch(head)):
            got = self[head] + self[u[-1]]  # letters and what is none
        else:
            ps = self.pattern.findall(u)
            got = self._word(ps[0]) if len(ps) == 1 else b"".join([self[p] for p in ps])
        self[u] = got
        return got

    def _word(self, p: str) -> bytes:
        """Ids of one word by the tokenizer's model alone; its alphabet has a printable character for every byte."""
        if not (p.isascii() and p.isprintable()):
            p = p.encode().decode("latin-1").translate(_BYTE_CHARS)
        return array(self.code, [t.id for t in self.model.tokenize(p)]).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as bytes of ``dtype``."""
        whole = {i for i, t in enumerate(texts) if "<|" in t or (any(c in t for c in _ODD_ASCII) if t.isascii() else _ODD_SPACE.search(t))}
        out = [b"" if i in whole else b"".join(map(self.__getitem__, normalised(t).split())) for i, t in enumerate(texts)]
        for i, b in zip(whole, self._raw([texts[i] for i in whole]), strict=True):
            out[i] = b
        if len(self) > _CACHE:
            self.clear()
        return out


_ids: dict[str | None, WordIds] = {}


CACHES["packing"] = _ids.clear


def word_ids(path: str | None) -> WordIds:
    """One per worker process."""
    if path not in _ids:
        _ids[path] = WordIds(path)
    return _ids[path]


# --------------------------------------------------------------------------- packing
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def sequence_starts(total: int, length: int = LENGTH) -> tuple[int, list[int]]:
    """Ids in full sequences, and the starts of the further ones: the rest cut at its powers of two."""
    full = total // length * length
    starts, at = [], full
    for b in range(length.bit_length() - 1, -1, -1):
        if (total - full) >> b & 1:
            starts.append(at)
            at += 1 << b
    return full, starts


def pack(docs: DataFrame, tokenizer_path: str | None = None, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row per piece of a document in a sequence."""
    spark = docs.sparkSession
    tmp = Scratch(spark, "packing")
    p = shuffle_partitions(spark)
    low = (crc_text(docs["doc_id"]) % 32768).alias("low")

    def encoded(b):
        """Slices of a batch with their documents' ids (end id last) and sort keys."""
        ids = word_ids(tokenizer_path)
        end = np.array([end_id], ids.dtype).tobytes()
        for part, _, _ in text_chunks(b):
            enc = [e + end for e in ids.encode([t or "" for t in part.column(part.schema.get_field_index("text")).to_pylist()])]
            n = np.array([len(e) for e in enc], np.int64) // ids.dtype().itemsize
            at = np.concatenate(([0], np.cumsum(n)))
            keys = curve_keys(np.frombuffer(b"".join(enc), ids.dtype), at, ids.table)
            yield part, enc, n, (keys << np.int64(15)) | np.asarray(part.column(part.schema.get_field_index("low")), np.int64)

    def key_kernel(b):
        for _, _, _, key in encoded(b):
            yield pa.RecordBatch.from_arrays([pa.array(key)], names=["key"])

    # bounds of the range partitions from a sample of the keys, as a range shuffle takes them; they shift work, not results
    sample = map_arrow(docs.sample(0.01, 7).select("text", low), key_kernel, "key long", "packing")
    cuts = sample.agg(F.percentile_approx("key", [i / p for i in range(1, p)] or [0.5], 20 * p)).first()[0]
    bounds = np.array(sorted(set(cuts or [])), np.int64)

    def ids_kernel(b):
        size = word_ids(tokenizer_path).dtype().itemsize
        for part, enc, n, key in encoded(b):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(key), pa.array(np.searchsorted(bounds, key, side="right").astype(np.int32)), pa.array(n), pa.array([size] * len(enc), pa.int32()), pa.array(enc, pa.binary())], names=["doc_id", "key", "part", "doc_tokens", "size", "ids"])

    rows = map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", low), ids_kernel, "doc_id long, key long, part int, doc_tokens long, size int, ids binary", "packing")

    def running(batches):
        """Ids before each document within its partition."""
        at = 0
        for b in batches:
            n = np.asarray(b.column(3), np.int64)
            s = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in (0, 2, 3, 4, 5)), pa.array(s)], names=["doc_id", "part", "doc_tokens", "size", "ids", "before"])

    laid = rows.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("key", "doc_id", "ids").mapInArrow(running, "doc_id long, part int, doc_tokens long, size int, ids binary, before long")
    laid = tmp.table(laid, "laid")
    per = {r["part"]: r["n"] for r in laid.groupBy("part").agg(F.sum("doc_tokens").alias("n")).collect()}  # one row per partition
    base, total = {}, 0
    for k in sorted(per):
        base[k] = total
        total += per[k]
    full, tail = sequence_starts(total, length)
    more = np.array(tail, np.int64)

    def cut(b):
        out: list[list] = [[] for _ in range(7)]
        for doc_id, part, n, size, ids, before in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
            a = np.frombuffer(ids, np.uint16 if size == 2 else np.uint32).astype("<u4")
            at = base[part] + before
            first, last = at // length + 1, -(-min(at + n, full) // length)
            marks = [m * length for m in range(first, last + 1) if at < m * length < at + n]
            marks += [int(m) for m in more if at < m < at + n and m not in marks]
            for s, e in zip([at, *marks], [*marks, at + n], strict=True):
                if s < full:
                    seq, off = s // length, s % length
                else:
                    i = int(np.searchsorted(more, s, side="right")) - 1
                    seq, off = full // length + i, s - int(more[i])
                for c, v in zip(out, (doc_id, s - at, e - s, zlib.crc32(a[s - at : e - at].tobytes()), n, seq, off), strict=True):
                    c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=[f.split()[0] for f in _PIECES.split(", ")])

    return map_arrow(laid, cut, _PIECES)
