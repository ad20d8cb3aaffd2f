"""SentencePiece encoding by streaming Viterbi, and decoding.

The pieces and scores of a model file are used as a unigram model: a text's ids are its segmentation
of highest total score, ties to the longer last piece; characters without a piece become byte pieces.
The encoder goes through a text position by position with a window of ``longest`` characters ahead. The
positions in which a path can still be are traced back together; where all their back pointers
meet, no later character can change what lies before, and those ids are committed and forgotten.

White space always starts a piece (checked on the model), so what is committed for a word between
such boundaries is the same wherever it stands; every worker keeps the ids of words it has seen.

The shared model file is of the merge kind; its merges are not replayed. Ids equal the SentencePiece
library's best segmentation (its n-best search) with the same pieces and scores as a unigram model.

Edges: null and empty texts have no ids; the marker U+2581 in a text decodes to a space, as in the
library; repeated rows are encoded as rows of their own.
"""

from __future__ import annotations

import math
import re
from array import array
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonaril.llm.common import CACHES, map_arrow

SPACE = "▁"
_MEMO = 600_000


class PieceModel:
    def __init__(self, path: str | None = None):
        import sentencepiece

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("piece_bpe_32k.model")
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.pieces = {names[i]: (i, sp.get_score(i)) for i in plain}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.longest = max(map(len, self.pieces))
        self.unknown = min(s for _, s in self.pieces.values()) - 10.0
        #: pieces and their prefixes (None): where one is missing, no longer piece starts with it
        self.table = {p[:k]: self.pieces.get(p[:k]) for p in self.pieces for k in range(1, len(p) + 1)}
        self.word_starts = not any(SPACE in p.lstrip(SPACE) for p in self.pieces)
        self.text_of = [b""] * n
        for i in plain:
            self.text_of[i] = names[i].replace(SPACE, " ").encode()
        for b, i in enumerate(self.bytes):
            self.text_of[i] = bytes([b])
        self.memo: dict[str, bytes] = {}

    # ------------------------------------------------------------------ encoding
    def stream(self, chars, commit_every: int | None = None):
        """Ids of a character stream (white space as the marker), committed as soon as no path can change them.

        Positions are taken in order; from each, the pieces that begin there are tried, which needs ``longest`` characters
        ahead and, of what lies behind, only what isn't committed.
        """
        get, longest, unknown, least = self.table.get, self.longest, self.unknown, -math.inf
        step, ahead, plain = commit_every or longest, 4 * longest, isinstance(chars, str)
        source = None if plain else iter(chars)
        # by position, from ``base`` on: the characters, the best score and (start, id or None) of the last piece
        buf = chars[:ahead] if plain else "".join(islice(source, ahead))
        size = read = len(buf)
        score, back = [0.0] + [least] * size, [(0, None)] * (size + 1)
        base = done = at = 0
        check, open_ = step, size == ahead
        while True:
            # up to the next look for a meeting point, or until characters must be read
            stop = min(check - base, size - longest + 1 if open_ else size)
            for at in range(at, stop):
                here, single, end = score[at], False, at + longest
                for e in range(at + 1, (end if end < size else size) + 1):  # earlier starts come first: the longer piece wins ties
                    hit = get(buf[at:e], False)
                    if hit:
                        if e == at + 1:
                            single = True
                        there = here + hit[1]
                        if there > score[e]:
                            score[e], back[e] = there, (base + at, hit[0])
                    elif hit is False:
                        break
                if not single and here + unknown > score[at + 1]:
                    score[at + 1], back[at + 1] = here + unknown, (base + at, None)
            at = max(at, stop) if stop > 0 else at
            if not open_ and at >= size:
                break
            if at >= check - base:
                # any path goes through this place or ends a piece, begun before it, within the window
                met = self._meet(back, base, [p for p in range(base + at, min(base + at + longest, base + size + 1)) if score[p - base] > least])
                if met > done:
                    yield from self._ids(back, buf, base, done, met)
                    done = met
                check += step
            else:
                chunk = chars[read : read + ahead] if plain else "".join(islice(source, ahead))
                read += len(chunk)
                open_ = len(chunk) == ahead
                cut, base, at = done - base, done, at + base - done  # nothing before the last commitment is asked for again
                buf, score, back = buf[cut:] + chunk, score[cut:] + [least] * len(chunk), back[cut:] + [(0, None)] * len(chunk)
                size = len(buf)
        if base + size > done:
            yield from self._ids(back, buf, base, done, base + size)

    @staticmethod
    def _meet(back: list, base: int, ends: list[int]) -> int:
        """The last boundary that all paths ending in ``ends`` share."""
        live = set(ends)
        while len(live) > 1:
            last = max(live)
            live.remove(last)
            live.add(back[last - base][0])
        return live.pop()

    def _ids(self, back: list, buf: str, base: int, lo: int, hi: int) -> list[int]:
        out: list[list[int]] = []
        p = hi
        while p > lo:
            start, i = back[p - base]
            out.append([i] if i is not None else [self.bytes[b] for b in buf[start - base : p - base].encode()])
            p = start
        return [i for part in reversed(out) for i in part]

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        marked = SPACE + text.replace(" ", SPACE)
        if not self.word_starts:
            return np.fromiter(self.stream(marked), "<u4").tobytes()
        units = _UNITS.findall(marked)
        memo = self.memo
        for u in set(units).difference(memo):
            memo[u] = array("I", self.stream(u)).tobytes()
        out = b"".join(map(memo.__getitem__, units))
        if len(memo) > _MEMO:
            memo.clear()
        return out

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.text_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw.decode("utf-8", "replace")[1:]


#: No piece has a line feed or a marker behind another character, so paths always meet there.
_UNITS = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")

_models: dict[str | None, PieceModel] = {}
CACHES["pieces"] = _models.clear


def model(path: str | None = None) -> PieceModel:
    """One per worker process."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


# --------------------------------------------------------------------------- DataFrame forms
def encode(df: DataFrame, path: str | None = None, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with its text's ids (binary, unsigned 32-bit little-endian)."""
    keep = df.drop(out)
    at = keep.columns.index(text_col)

    def kernel(b):
        m = model(path)
        for part in (b.slice(i, 256) for i in range(0, b.num_rows, 256)):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([m.encode(t) for t in part.column(at).to_pylist()], pa.binary())], names=[*part.schema.names, out])

    return map_arrow(keep, kernel, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep.schema) + f", `{out}` binary", "pieces")


def decode(df: DataFrame, path: str | None = None, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text of its ids."""
    keep = df.drop(out)
    at = keep.columns.index(ids_col)

    def kernel(b):
        m = model(path)
        for part in (b.slice(i, 256) for i in range(0, b.num_rows, 256)):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([m.decode(x or b"") for x in part.column(at).to_pylist()], pa.string())], names=[*part.schema.names, out])

    return map_arrow(keep, kernel, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep.schema) + f", `{out}` string", "pieces")


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_ids, ids_crc32, decoded_sha256) of every document; the last is of the decoded ids."""
    coded = decode(encode(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), path).drop("text"), path)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"), F.sha2("decoded", 256).alias("decoded_sha256"))
