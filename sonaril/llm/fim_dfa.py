"""Fill-in-middle transformation of texts, cut at units found by a table-driven automaton over bytes.

A unit is white space and the word after it, or white space at the end. One scan by a table of states
handles UTF-8 (which bytes begin a code point), unit boundaries and the sentinels at once; every
transition carries what it counts: a code point, a unit, a completed sentinel. A second pass turns the
counts into cuts: the byte of the k-th unit, and the code points before it. The automaton's state
follows from the last few bytes (``Automaton.memory``), so a scan runs many lanes of a text side by
side, each begun that many bytes early; texts are joined by a byte that UTF-8 hasn't and that resets it.

Prefix and middle end after the smaller and the larger of two unit numbers drawn from a hash of seed and
id, so any task, any retry and any order of rows gives the same cuts.

Edges: null and empty texts are plain and empty; so is the output of texts that hold a sentinel: the
text as it is. A null id hashes as no digits. Repeated rows give equal rows. Very long texts are
scanned by blocks: besides the text, a scan keeps two bytes a byte. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonaril.llm.common import free_names, map_arrow, text_chunks

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
END = 0xFF  # no byte of UTF-8
POINT, UNIT, MARK = 1, 2, 2  # flags of an emission; from bit MARK on: which sentinel is complete, from 1
LANE, BLOCK = 256, 1 << 20


class Automaton:
    """Tables of the automaton for some sentinels: class of each byte, next state and emission by (state, class)."""

    def __init__(self, sentinels: tuple[bytes, ...]):
        self.sentinels = sentinels
        self.memory = max(3, *(len(s) - 1 for s in sentinels))
        own = sorted(set(b"".join(sentinels)))
        kinds = [("end",), ("space",), ("other",), ("more",), ("lead", 1), ("lead", 2), ("lead", 3), *(("byte", x) for x in own)]
        of = {k: i for i, k in enumerate(kinds)}
        self.classes = np.array([of[self._kind(x, own)] for x in range(256)], np.uint8)
        start = ("start", b"", 0)
        states, todo = {start: 0}, [start]
        step, emit = [], []
        for state in todo:  # grows while new states are found
            for kind in kinds:
                after, out = self._step(state, kind)
                if after not in states:
                    states[after] = len(states)
                    todo.append(after)
                step.append(states[after])
                emit.append(out)
        self.n_states, self.n_classes = len(states), len(kinds)
        self.step = np.array(step, np.int32) * len(kinds)  # ready to have a class added
        self.emit = np.array(emit, np.uint8)

    @staticmethod
    def _kind(x: int, own: list[int]) -> tuple:
        if x == END:
            return ("end",)
        if x in own:
            return ("byte", x)
        if x == 0x20 or 0x09 <= x <= 0x0D:
            return ("space",)
        if 0x80 <= x < 0xC0:
            return ("more",)
        if x >= 0xC0:
            return ("lead", 1 if x < 0xE0 else 2 if x < 0xF0 else 3)
        return ("other",)

    def _step(self, state: tuple, kind: tuple) -> tuple[tuple, int]:
        place, seen, pending = state
        if kind[0] == "end":
            return ("start", b"", 0), 0
        if kind[0] == "more" and pending:
            return (place, b"", pending - 1), 0
        space = kind[0] == "space" or kind[0] == "byte" and (kind[1] == 0x20 or 0x09 <= kind[1] <= 0x0D)
        out = POINT | (UNIT if place == "start" or space and place == "word" else 0)
        now = b""
        if kind[0] == "byte":
            now = seen + bytes([kind[1]])
            for i, s in enumerate(self.sentinels):
                if now.endswith(s):
                    out |= (i + 1) << MARK
            while not any(len(now) < len(s) and s.startswith(now) for s in self.sentinels):
                now = now[1:]
        return ("space" if space else "word", now, kind[1] if kind[0] == "lead" else 0), out

    def scan(self, data: np.ndarray) -> np.ndarray:
        """The emission of every byte's transition."""
        out = np.empty(len(data), np.uint8)
        for at in range(0, len(data), BLOCK):
            out[at : at + BLOCK] = self._lanes(data, at, min(at + BLOCK, len(data)))
        return out

    def _lanes(self, data: np.ndarray, lo: int, hi: int) -> np.ndarray:
        early, lanes = self.memory, -(-(hi - lo) // LANE)
        padded = np.full(early + lanes * LANE, END, np.uint8)  # a reset before the data's first byte
        have = min(early, lo)
        padded[early - have : early + hi - lo] = data[lo - have : hi]
        cls = self.classes[padded]
        rows = np.lib.stride_tricks.sliding_window_view(cls, early + LANE)[::LANE]
        columns = np.ascontiguousarray(rows.T)
        state = np.zeros(lanes, np.int32)
        out = np.empty((LANE, lanes), np.uint8)
        for t in range(early):
            state = self.step[state + columns[t]]
        for t in range(LANE):
            at = state + columns[early + t]
            out[t] = self.emit[at]
            state = self.step[at]
        return np.ascontiguousarray(out.T).ravel()[: hi - lo]


class Spec(NamedTuple):
    """Seed, shares of a hundred that are transformed and of these in the order suffix first, and the sentinels."""

    seed: int = 42
    rate: int = 50
    suffix_first: int = 80
    prefix: bytes = PREFIX
    suffix: bytes = SUFFIX
    middle: bytes = MIDDLE


def draws(spec: Spec, doc_id: int | None) -> tuple[int, ...]:
    """Four 32-bit numbers of a document."""
    h = hashlib.sha256(f"{spec.seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(h[i : i + 4], "big") for i in (0, 4, 8, 12))


def joined(bodies: list) -> tuple[np.ndarray, np.ndarray]:
    """Texts with the mark END after each, and where each begins."""
    at = np.zeros(len(bodies) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in bodies], out=at[1:])
    data = np.full(at[-1], END, np.uint8)
    for i, x in enumerate(bodies):
        data[at[i] : at[i] + len(x)] = np.frombuffer(x, np.uint8)
    return data, at


class Cut(NamedTuple):
    n: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    output: bytes


def cut_text(spec: Spec, doc_id: int | None, text: memoryview, events: np.ndarray) -> Cut:
    """Second pass over a text's emissions: count, draw, locate the cuts, put together."""
    units = np.flatnonzero(events & UNIT)
    n = len(units)
    h1, h2, h3, h4 = draws(spec, doc_id)
    if not n or h3 % 100 >= spec.rate or (events >> MARK).any():
        return Cut(n, "plain", None, None, bytes(text))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    ends = [int(units[k]) if k < n else len(text) for k in (a, b)]
    prefix, middle, suffix = bytes(text[: ends[0]]), bytes(text[ends[0] : ends[1]]), bytes(text[ends[1] :])
    chars = [int(np.count_nonzero(events[x:y] & POINT)) for x, y in ((0, ends[0]), (ends[0], ends[1]))]
    if h4 % 100 < spec.suffix_first:
        return Cut(n, "spm", *chars, spec.suffix + suffix + spec.prefix + prefix + spec.middle + middle)
    return Cut(n, "psm", *chars, spec.prefix + prefix + spec.suffix + suffix + spec.middle + middle)


def restore(spec: Spec, form: str, output: bytes, events: np.ndarray) -> bytes:
    """The text, from the output and its form; ``events``: the automaton's emissions over the output.

    No text holds a sentinel, and none begins inside another, so the output's three sentinels are the inserted ones.
    """
    if form == "plain":
        return output
    marks = np.flatnonzero(events >> MARK) + 1  # first byte after each
    size = (len(spec.suffix), len(spec.prefix), len(spec.middle)) if form == "spm" else (len(spec.prefix), len(spec.suffix), len(spec.middle))
    parts = [output[marks[i] : marks[i + 1] - size[i + 1] if i < 2 else None] for i in range(3)]
    return parts[1] + parts[2] + parts[0] if form == "spm" else parts[0] + parts[2] + parts[1]


def cuts(spec: Spec, automaton: Automaton, ids: list, data: np.ndarray, offs: np.ndarray) -> tuple[list[Cut], list[bytes]]:
    """Cuts of a chunk of texts, and the texts rebuilt from them."""
    raw = memoryview(np.ascontiguousarray(data)).cast("B")
    texts = [raw[offs[i] : offs[i + 1]] for i in range(len(ids))]
    buf, at = joined(texts)
    events = automaton.scan(buf)
    out = [cut_text(spec, d, t, events[at[i] : at[i] + len(t)]) for i, (d, t) in enumerate(zip(ids, texts, strict=True))]
    buf, at = joined([c.output for c in out])
    events = automaton.scan(buf)
    back = [restore(spec, c.form, c.output, events[at[i] : at[i] + len(c.output)]) for i, c in enumerate(out)]
    return out, back


def fill_in_middle(docs: DataFrame, spec: Spec = Spec()) -> DataFrame:
    """``docs`` with the transformed text in ``text``, and fim_form, fim_prefix_chars, fim_middle_chars (renamed where taken)."""
    form, prefix, middle = free_names(docs, "fim_form", "fim_prefix_chars", "fim_middle_chars")
    others = [c for c in docs.columns if c != "text"]
    id_, text = free_names(docs, "_id", "_text")
    rows = docs.select(F.col("doc_id").cast("long").alias(id_), F.col("text").alias(text), *[F.col(f"`{c}`") for c in others])
    # the kernel drops the text and appends its own; the id it reads goes afterwards
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != text)
    names = [f.name for f in rows.schema if f.name != text] + ["text", form, prefix, middle]
    automaton = Automaton((spec.prefix, spec.suffix, spec.middle))

    def kernel(b) -> Iterator[pa.RecordBatch]:
        for part, data, offs in text_chunks(b, text):
            out, _ = cuts(spec, automaton, part.column(0).to_pylist(), data, offs)
            own = [pa.array([c.output.decode("utf-8", "replace") for c in out], pa.string()), pa.array([c.form for c in out]), pa.array([c.prefix_chars for c in out], pa.int64()), pa.array([c.middle_chars for c in out], pa.int64())]
            yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], *own], names=names)

    made = map_arrow(rows, kernel, f"{kinds}, text string, `{form}` string, `{prefix}` long, `{middle}` long")
    return made.select(*[F.col(f"`{c}`") for c in docs.columns], f"`{form}`", f"`{prefix}`", f"`{middle}`")


def digest(docs: DataFrame, spec: Spec = Spec()) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of every document."""

    automaton = Automaton((spec.prefix, spec.suffix, spec.middle))
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]

    def kernel(b) -> Iterator[pa.RecordBatch]:
        for part, data, offs in text_chunks(b):
            out, back = cuts(spec, automaton, part.column(0).to_pylist(), data, offs)
            sha = [pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string()) for xs in ([c.output for c in out], back)]
            counts = [pa.array([c.n for c in out], pa.int64()), pa.array([c.form for c in out], pa.string()), *(pa.array([c[k] for c in out], pa.int64()) for k in (2, 3))]
            yield pa.RecordBatch.from_arrays([part.column(0), *counts, *sha], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_arrow(rows, kernel, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")
