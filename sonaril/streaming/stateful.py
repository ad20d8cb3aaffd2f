"""Resampling and framing of sample streams that arrive in ragged pieces.

One row per piece: (stream_id, seq, samples array<short>, eos), seq counting from 0. State is the input that later
output still needs, the running read position, and pieces that came before their turn; any split into
micro-batches, and any order of the pieces over them, gives the same output. A piece that comes again is dropped.
At most ``WAITING`` pieces of a stream may wait for one that is missing: more fail the query, whose
checkpoint still has all before them, so state can't grow without end behind a lost piece.
"""

from __future__ import annotations

import math
import pickle
import struct
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sonaril.operators.allpass import Raiser
from sonaril.operators.resample import DENSITY, kernel_shape, kernel_table

WAITING = 4096
PIECES = "stream_id string, seq long, samples array<short>, eos boolean"


class ResampleState:
    """The rate converter as a step function: history, its first index, and the number of outputs so far."""

    def __init__(self, rate_in: int, rate_out: int, buf: np.ndarray | None = None, base: int = 0, done: int = 0):
        _, self.half = kernel_shape(rate_in, rate_out)
        self.kernel = np.array(kernel_table(rate_in, rate_out) + [0.0])
        self.step = Fraction(rate_in, rate_out)
        self.buf, self.base, self.done = np.zeros(0) if buf is None else buf, base, done

    def push(self, samples: np.ndarray, final: bool = False) -> np.ndarray:
        self.buf = np.concatenate((self.buf, samples))
        end = self.base + len(self.buf)
        limit = end if final else end - self.half
        # outputs at half + j * step below the limit
        n = max(0, math.ceil((limit - self.half) / self.step))
        j = np.arange(self.done, max(n, self.done))
        out = np.zeros(len(j), np.int64)
        for i in range(0, len(j), 2048):
            p = self.half + j[i : i + 2048] * self.step.numerator / self.step.denominator
            at = np.ceil(p - self.half).astype(np.int64)[:, None] + np.arange(2 * self.half + 1)[None, :]
            d = np.abs(at - p[:, None]) * DENSITY
            k = np.floor(d).astype(np.int64)
            live = (at >= self.base) & (at < end) & (k < self.half * DENSITY)
            k = np.where(live, k, 0)
            w = np.where(live, (1 - (d - k)) * self.kernel[k] + (d - k) * self.kernel[k + 1], 0.0)
            x = np.where(live, self.buf[np.clip(at - self.base, 0, len(self.buf) - 1)], 0.0)
            out[i : i + 2048] = np.clip(np.rint((w * x).sum(1)), -32768, 32767)
        self.done = max(n, self.done)
        keep = max(self.base, math.floor(self.half + self.done * self.step) - self.half - 1)
        self.buf, self.base = self.buf[min(keep, end) - self.base :], min(keep, end)
        return out


class _Keyed(StatefulProcessor):
    """Pieces of a key in order of ``seq``; state as one binary value: the next seq, the pieces that wait, and the operator's own."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "data binary")

    def close(self) -> None:
        pass

    def _turn(self, rows: Iterator[pd.DataFrame]) -> tuple[bytes, list[tuple[np.ndarray, bool]]]:
        """The operator's own state, and the pieces whose turn it is."""
        self.next, self.waiting, own = pickle.loads(bytes(self.state.get()[0])) if self.state.exists() else (0, {}, b"")
        for frame in rows:
            for r in frame.itertuples():
                if r.seq >= self.next:
                    self.waiting[int(r.seq)] = (np.array(r.samples if r.samples is not None else [], "<i2").tobytes(), bool(r.eos))
        out = []
        while self.next in self.waiting:
            raw, eos = self.waiting.pop(self.next)
            out.append((np.frombuffer(raw, "<i2"), eos))
            self.next += 1
        if len(self.waiting) > WAITING:
            raise ValueError(f"piece {self.next} is missing, and {len(self.waiting)} later ones of its stream wait for it")
        return own, out

    def _keep(self, own: bytes) -> None:
        self.state.update((pickle.dumps((self.next, self.waiting, own)),))


class Resampler(_Keyed):
    def __init__(self, rate_in: int, rate_out: int):
        self.rates = rate_in, rate_out

    def handleInputRows(self, key, rows, timerValues):
        raw, pieces = self._turn(rows)
        base, done = struct.unpack_from("<qq", raw) if raw else (0, 0)
        st = ResampleState(*self.rates, buf=np.frombuffer(raw[16:], "<i2").astype(float) if raw else None, base=base, done=done)
        out = [st.push(samples.astype(float), eos) for samples, eos in pieces]
        self._keep(struct.pack("<qq", st.base, st.done) + st.buf.astype("<i2").tobytes())
        y = np.concatenate(out) if out else np.zeros(0, np.int64)
        yield pd.DataFrame({"stream_id": pd.Series([key[0]] * len(y), dtype=object), "n": np.arange(done, done + len(y)), "s": y.astype(np.int32)})


class Framer(_Keyed):
    """Fixed-size frames at a level, up to a number of frames; the short tail comes with the end of the stream."""

    def __init__(self, size: int, gain: float = 1.0, limit: int | None = None):
        self.size, self.gain, self.limit = size, gain, limit

    def handleInputRows(self, key, rows, timerValues):
        raw, pieces = self._turn(rows)
        frame = struct.unpack_from("<q", raw)[0] if raw else 0
        held = np.concatenate([np.frombuffer(raw[8:], "<i2"), *(samples for samples, _ in pieces)])
        eos = any(end for _, end in pieces)
        out = []
        while len(held) >= self.size or eos and len(held):
            if self.limit is None or frame < self.limit:
                out.append((frame, np.clip(np.rint(held[: self.size] * self.gain), -32768, 32767).astype(int).tolist()))
            held, frame = held[self.size :], frame + 1
        self._keep(struct.pack("<q", frame) + held.astype("<i2").tobytes())
        yield pd.DataFrame({"stream_id": pd.Series([key[0]] * len(out), dtype=object), "frame_no": pd.Series([f for f, _ in out], dtype="int64"), "samples": pd.Series([s for _, s in out], dtype=object)})


class VoiceRaiser(_Keyed):
    """Voice to 48 kHz: sections, doubled samples and a batch's held samples go from piece to piece, so the bits don't depend on the split."""

    def __init__(self, rate: int, frame_ms: int = 20):
        self.rate, self.frame = rate, rate // 1000 * frame_ms

    def handleInputRows(self, key, rows, timerValues):
        raw, pieces = self._turn(rows)
        st = Raiser(self.rate, self.frame)
        if raw:
            st.resume(pickle.loads(raw))
        done = st.done
        out = [st.push(samples.tolist(), eos) for samples, eos in pieces]
        self._keep(pickle.dumps(st.state()))
        y = np.concatenate(out) if out else np.zeros(0, np.int64)
        yield pd.DataFrame({"stream_id": pd.Series([key[0]] * len(y), dtype=object), "n": np.arange(done, done + len(y)), "s": y.astype(np.int32)})


def raise_stream(df: DataFrame, rate: int, frame_ms: int = 20) -> DataFrame:
    """Streaming DataFrame of pieces of voice at 8, 12 or 16 kHz -> (stream_id, n, s) at 48 kHz."""
    return df.groupBy("stream_id").transformWithStateInPandas(VoiceRaiser(rate, frame_ms), "stream_id string, n long, s int", "append", "None")


def resample_stream(df: DataFrame, rate_in: int, rate_out: int) -> DataFrame:
    """Streaming DataFrame of pieces -> (stream_id, n, s)."""
    return df.groupBy("stream_id").transformWithStateInPandas(Resampler(rate_in, rate_out), "stream_id string, n long, s int", "append", "None")


def frame_stream(df: DataFrame, size: int = 160, gain: float = 1.0, limit: int | None = None) -> DataFrame:
    """Streaming DataFrame of pieces -> (stream_id, frame_no, samples)."""
    return df.groupBy("stream_id").transformWithStateInPandas(Framer(size, gain, limit), "stream_id string, frame_no long, samples array<short>", "append", "None")
