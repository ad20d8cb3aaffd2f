"""Chat formatting: roles of a transcript's lines by a hidden Markov model, then canonical turns.

A state is a role and whether the line opens a turn. A line emits the speaker name it is marked with (or
none) and its features (length, question mark, case of its first letter). Transitions and emissions are
counted from labelled transcripts; names start with a pseudo-count for the role that they usually mean.
The roles are the Viterbi path.

A transcript comes in numbered parts. Each part's lines give one matrix (best log probability from
each state before the part to each state after it); matrices multiply in the (max, +) sense, so
``FAN`` consecutive parts give one matrix, and so on in rounds up to one row a transcript; the
states between parts follow in the same groups back down, and then every part is decoded by itself. No
group ever holds more than ``FAN`` small matrices, however long a conversation is. Lines are read once:
what they emit travels as two bytes a line, and all parts of a batch are decoded together.

Edges: null text is an empty part and gives no turns; rows without a conv_id are one conversation; a
null turn is turn 0; a repeated row is a line of its own; where a part holds more than ``CROWD`` rows (equal turns),
it is split by a hash of its rows; null or unlabelled roles teach nothing; with no labelled row
at all, transitions and features are uniform.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonaril.llm.common import Scratch, crc_text, map_arrow

ROLES = ("system", "user", "assistant", "tool")
PART = 64
# Speaker names of transcripts.
MARKERS = {
    "system": ("system", "sys", "instruction", "instructions", "context"),
    "user": ("user", "human", "customer", "client", "q", "question", "me", "you"),
    "assistant": ("assistant", "ai", "bot", "chatbot", "agent", "a", "answer", "gpt", "model"),
    "tool": ("tool", "function", "observation", "result"),
}
ROLE_OF = {w: r for r, ws in MARKERS.items() for w in ws}
NAMES = sorted(ROLE_OF)
_ID = {w: i for i, w in enumerate(NAMES)}
_ANY = "|".join(sorted(NAMES, key=len, reverse=True))
_MARK = re.compile(rf"^\s*(?:<\|(?:im_start\|>)?({_ANY})\|?>?|\[({_ANY})\]|\**({_ANY})\**\s*:\**|#+\s*({_ANY})\s*:?\s*$|#+\s*({_ANY})\s*:)\s*", re.I)
_N_FEATURES = 24
_N_MARKS = len(NAMES) + 1  # the last: none
_S = 2 * len(ROLES)  # state 2r opens a turn of role r, 2r + 1 goes on with it
FAN, CROWD = 64, 1024


def split_marker(line: str) -> tuple[int, str]:
    """Number of the name that a line is marked with (the last number: none), and the line without the mark."""
    m = _MARK.match(line)
    if not m:
        return _N_MARKS - 1, line
    return _ID[next(g for g in m.groups() if g).lower()], line[m.end() :]


def feature(line: str) -> int:
    n = len(line.split())
    size = 0 if n == 0 else 1 if n <= 4 else 2 if n <= 12 else 3 if n <= 30 else 4 if n <= 80 else 5
    head = line.lstrip()[:1]
    return size * 4 + 2 * line.rstrip().endswith("?") + head.islower()


def codes_of(text: str | None) -> np.ndarray:
    """What each line emits: mark and feature in one number."""
    out = []
    for line in text.split("\n") if text else []:
        m, rest = split_marker(line)
        out.append(m * _N_FEATURES + feature(rest))
    return np.array(out, np.int16)


class Hmm:
    def __init__(self, turns: np.ndarray, emitted: np.ndarray, first: np.ndarray):
        """Counts: role after role; (role, opens or goes on, code) of lines; first roles."""
        n = len(ROLES)
        turn = np.log((turns + 1) / (turns + 1).sum(1, keepdims=True))
        lines = emitted.reshape(n, 2, _N_MARKS, _N_FEATURES)
        more = lines.sum((2, 3))
        go_on = (more[:, 1] + 1) / (more.sum(1) + 2)
        self.trans = np.full((_S, _S), -np.inf)
        for r in range(n):
            for s in (2 * r, 2 * r + 1):
                self.trans[s, 2 * r + 1] = np.log(go_on[r])
                self.trans[s, 0::2] = np.log(1 - go_on[r]) + turn[r]
        self.start = np.full(_S, -np.inf)
        self.start[0::2] = np.log((first + 1) / (first + 1).sum())
        feat = lines.sum(2) + 1
        marks = lines.sum(3) + 0.01
        for w, i in _ID.items():  # before any count, a name opens a turn of the role it stands for
            marks[ROLES.index(ROLE_OF[w]), 0, i] += 10.0
        marks[:, 0, -1] += 10.0  # a turn may open without a name
        marks[:, 1, -1] += 1000.0
        mark = np.log(marks / marks.sum(2, keepdims=True)).reshape(_S, _N_MARKS)
        feat = np.log(feat / feat.sum(2, keepdims=True)).reshape(_S, _N_FEATURES)
        self.emit = (mark[:, :, None] + feat[:, None, :]).reshape(_S, -1).T.copy()  # code x state

    def _steps(self, codes: list[np.ndarray]):
        """Parts by falling length, and for every step the emissions of the parts that are that long."""
        size = np.array([len(c) for c in codes])
        order = np.argsort(-size, kind="stable")
        table = np.zeros((len(codes), int(size.max(initial=0))), np.int16)
        for i, k in enumerate(order.tolist()):
            table[i, : len(codes[k])] = codes[k]
        live = [int((size > t).sum()) for t in range(table.shape[1])]
        return order, (self.emit[table[:a, t]] for t, a in enumerate(live)), live

    def matrices(self, codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """For each part: best log probability from the state before it (row) to that of its last line; and from a transcript's start."""
        order, steps, live = self._steps(codes)
        m = np.tile(np.where(np.eye(_S, dtype=bool), 0.0, -np.inf), (len(codes), 1, 1))
        v = np.tile(self.start, (len(codes), 1))
        for t, (e, a) in enumerate(zip(steps, live, strict=True)):
            m[:a] = (m[:a, :, :, None] + self.trans).max(2) + e[:, None, :]
            v[:a] = (v[:a] if t == 0 else (v[:a, :, None] + self.trans).max(1)) + e
        back = np.argsort(order)
        return m[back], v[back]

    def paths(self, codes: list[np.ndarray], before: np.ndarray, after: np.ndarray) -> list[list[int]]:
        """States of the lines on the best path between two given states; before < 0: the transcript's start, after < 0: any."""
        order, steps, live = self._steps(codes)
        before, after = before[order], after[order]
        v = np.where((before < 0)[:, None], self.start, self.trans[np.maximum(before, 0)])
        ends = np.zeros((len(codes), _S))
        back = []
        for t, (e, a) in enumerate(zip(steps, live, strict=True)):
            if t:
                z = v[:a, :, None] + self.trans
                back.append(z.argmax(1).astype(np.int8))
                v = z.max(1)
            v = v[:a] + e
            ends[:a] = v
        s = np.where(after >= 0, after, ends.argmax(1))
        rows: list[np.ndarray] = []
        for t in range(len(live) - 1, -1, -1):
            rows.append(s[: live[t]].copy())
            if t:
                s[: live[t]] = back[t - 1][np.arange(live[t]), s[: live[t]]]
        rows.reverse()
        out: list[list[int]] = [[] for _ in codes]
        for i, k in enumerate(order.tolist()):
            out[k] = [int(rows[t][i]) for t in range(len(codes[k]))]
        return out


def chain(full: list[int], ms: np.ndarray, opening: np.ndarray, before: int, after: int) -> tuple[dict[int, int], dict[int, int]]:
    """States before and after each of consecutive parts ``full`` (those with lines), between given states (< 0: start, any)."""
    vs: list[np.ndarray] = []
    for k, i in enumerate(full):
        vs.append((vs[-1][:, None] + ms[i]).max(0) if k else opening[i] if before < 0 else ms[i][before])
    b, a = {}, {}
    for k in reversed(range(len(full))):
        a[full[k]] = (after if after >= 0 else int(vs[k].argmax())) if k == len(full) - 1 else b[full[k + 1]]
        b[full[k]] = int((vs[k - 1] + ms[full[k]][:, a[full[k]]]).argmax()) if k else before
    return b, a


def fit(lines: DataFrame) -> Hmm:
    """Counts from labelled lines (conv_id, turn, role, line: a turn's lines); a fixed number of cells comes to the driver."""
    n = len(ROLES)
    known = lines.filter(F.col("role").isin(*ROLES)).select("conv_id", F.coalesce("turn", F.lit(0)).alias("turn"), "role", F.coalesce("line", F.lit("")).alias("line"))

    def kernel(b):
        out = [(r, int(k > 0), int(x)) for r, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for k, x in enumerate(codes_of(t) if t else [(_N_MARKS - 1) * _N_FEATURES])]
        u = pd.DataFrame(out, columns=["role", "more", "code"]).value_counts().reset_index(name="n")
        yield pa.RecordBatch.from_pandas(u.astype({"more": "int32", "code": "int32", "n": "int64"}), preserve_index=False)

    cells = map_arrow(known.select("role", "line"), kernel, "role string, more int, code int, n long").groupBy("role", "more", "code").agg(F.sum("n").alias("n")).collect()
    emitted = np.zeros((n, 2, _N_MARKS * _N_FEATURES))
    for c in cells:
        emitted[ROLES.index(c["role"]), c["more"], c["code"]] += c["n"]
    one = known.groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    after = one.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("next"))
    turns, first = np.zeros((n, n)), np.zeros(n)
    for c in one.join(after, ["conv_id", "turn"]).groupBy("role", "next").count().collect():
        turns[ROLES.index(c["role"]), ROLES.index(c["next"])] = c["count"]
    for c in one.filter("turn = 0").groupBy("role").count().collect():
        first[ROLES.index(c["role"])] = c["count"]
    return Hmm(turns, emitted, first)


def render(role: str, content: str) -> str:
    return f"<|im_start|>{role}\n{content}<|im_end|>\n"


_NODE = "key long, pos long, n long, m array<double>, opening array<double>"


def _combine(pdf: pd.DataFrame, fan: int) -> pd.DataFrame:
    """Up to ``fan`` consecutive parts as one."""
    pdf = pdf.sort_values("pos")
    key, pos = int(pdf["key"].iloc[0]), int(pdf["pos"].iloc[0]) // fan
    some = pdf[pdf["n"] > 0]
    m = np.where(np.eye(_S, dtype=bool), 0.0, -np.inf)
    v = None
    for x, o in zip(some["m"], some["opening"], strict=True):
        x = np.asarray(x).reshape(_S, _S)
        v = np.asarray(o) if v is None else (v[:, None] + x).max(0)
        m = (m[:, :, None] + x[None, :, :]).max(1)
    v = np.zeros(_S) if v is None else v
    return pd.DataFrame({"key": [key], "pos": [pos], "n": [int(some["n"].sum())], "m": [m.ravel()], "opening": [v]})


def _between(pdf: pd.DataFrame) -> pd.DataFrame:
    """States before and after each of a few consecutive parts whose parent's are known; -1 where there is none."""
    pdf = pdf.sort_values("pos").reset_index(drop=True)
    full = np.flatnonzero(pdf["n"].to_numpy() > 0).tolist()
    ms = np.stack([np.asarray(x).reshape(_S, _S) for x in pdf["m"]])
    b, a = chain(full, ms, np.stack([np.asarray(x) for x in pdf["opening"]]), int(pdf["up_before"].iloc[0]), int(pdf["up_after"].iloc[0]))
    at = range(len(pdf))
    return pd.DataFrame({"key": pdf["key"], "pos": pdf["pos"], "before": [b.get(i, -1) for i in at], "after": [a.get(i, -1) for i in at]})


def parse(parts: DataFrame, hmm: Hmm, fan: int = FAN) -> DataFrame:
    """(conv_id, part, seq, role, continued, content, rendered): the turns of transcripts given as (conv_id, part, text).

    A turn that goes on from the part before has continued = true.
    """
    tmp = Scratch(parts.sparkSession, "chat")
    sc = parts.sparkSession.sparkContext.broadcast(hmm)
    given = parts.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(-(1 << 63))).alias("key"), F.col("conv_id").cast("long").alias("conv_id"), F.col("part").cast("long").alias("part"), "text")

    def read(b):
        codes = [codes_of(t) for t in b.column(3).to_pylist()]
        m, v = sc.value.matrices(codes)
        lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([len(c) for c in codes], pa.int64()), pa.array([c.tobytes() for c in codes], pa.binary()), lists(m.reshape(len(codes), -1)), lists(v)], names=["key", "conv_id", "part", "text", "n", "codes", "m", "opening"])

    src = tmp.table(map_arrow(given, lambda b: (x for i in range(0, b.num_rows, 256) for x in read(b.slice(i, 256))), "key long, conv_id long, part long, text string, n long, codes binary, m array<double>, opening array<double>"), "parts")
    low, high = src.agg(F.min("part"), F.max("part")).first()
    low, span = low or 0, (high or 0) - (low or 0)
    # a transcript of one part has no state between parts
    several = src.groupBy("key").count().filter("count > 1").select("key")
    levels = [src.join(several, "key").select("key", (F.col("part") - F.lit(low)).alias("pos"), "n", "m", "opening")]
    while span >= fan:
        span //= fan
        up = levels[-1].withColumn("up", F.floor(F.col("pos") / fan)).groupBy("key", "up").applyInPandas(lambda pdf: _combine(pdf, fan), _NODE)
        levels.append(tmp.table(up, f"level{len(levels)}"))
    known = None
    for i, level in reversed(list(enumerate(levels))):
        level = level.withColumn("up", F.floor(F.col("pos") / fan))
        if known is None:
            level = level.withColumn("up_before", F.lit(-1)).withColumn("up_after", F.lit(-1))
        else:
            level = level.join(known.select("key", F.col("pos").alias("up"), F.col("before").alias("up_before"), F.col("after").alias("up_after")), ["key", "up"])
        known = tmp.table(level.groupBy("key", "up").applyInPandas(_between, "key long, pos long, before int, after int"), f"states{i}")

    def turns(b):
        lines = [t.split("\n") if t else [] for t in b.column(2).to_pylist()]
        codes = [np.frombuffer(c, np.int16) for c in b.column(3).to_pylist()]
        states = sc.value.paths(codes, np.asarray(b.column(4)), np.asarray(b.column(5)))
        out: list[list] = [[] for _ in range(6)]
        for conv, part, text, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), lines, states, strict=True):
            seq = 0
            for s, line in zip(path, text, strict=True):
                body = split_marker(line)[1] if s % 2 == 0 else line
                if s % 2 == 0 or seq == 0:
                    for c, v in zip(out, (conv, part, seq, ROLES[s // 2], s % 2 == 1, [body]), strict=True):
                        c.append(v)
                    seq += 1
                else:
                    out[5][-1].append(body)
        content = ["\n".join(x).strip("\n") for x in out[5]]
        cols = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.string()), pa.array(out[4], pa.bool_()), pa.array(content, pa.string()), pa.array([render(r, c) for r, c in zip(out[3], content, strict=True)], pa.string())]
        yield pa.RecordBatch.from_arrays(cols, names=["conv_id", "part", "seq", "role", "continued", "content", "rendered"])

    ends = known.select("key", (F.col("pos") + F.lit(low)).alias("part"), "before", "after")
    none = F.lit(-1)
    both = src.join(ends, ["key", "part"], "left").select("conv_id", "part", "text", "codes", F.coalesce("before", none).alias("before"), F.coalesce("after", none).alias("after"))
    return map_arrow(both, lambda b: (x for i in range(0, b.num_rows, 256) for x in turns(b.slice(i, 256))), "conv_id long, part long, seq int, role string, continued boolean, content string, rendered string")


def marked_lines(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, line): each turn with its speaker's name before it, in one of four styles for a conversation."""
    role = F.when(F.col("role").isin(*ROLES), F.col("role"))
    style = F.pmod(F.xxhash64("conv_id"), F.lit(4))
    name = F.initcap(role)
    mark = F.when(style == 0, F.concat(name, F.lit(": "))).when(style == 1, F.concat(F.lit("["), F.upper(role), F.lit("] "))).when(style == 2, F.concat(F.lit("<|"), role, F.lit("|>"))).otherwise(F.concat(F.lit("### "), name, F.lit(":\n")))
    line = F.concat(F.coalesce(mark, F.lit("")), F.coalesce("text", F.lit("")))
    return conversations.select("conv_id", F.coalesce("turn", F.lit(0)).cast("long").alias("turn"), "role", line.alias("line"))


def transcripts(lines: DataFrame, size: int = PART, crowd: int = CROWD) -> DataFrame:
    """(conv_id, part, text) from (conv_id, turn, line): transcripts in parts of ``size`` turns, in order.

    A part of more than ``crowd`` rows goes turn by turn, so the transcript is the same; rows of one turn have no order among
    themselves (they are sorted where they meet), and only one turn of more than ``crowd`` rows is dealt out.
    """
    rows = lines.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(-(1 << 63))).alias("key"), F.col("conv_id").cast("long").alias("conv_id"), F.floor(F.col("turn") / size).cast("long").alias("part"), "turn", "line")
    per_turn = rows.groupBy("key", "part", "turn").count()
    crowds = per_turn.groupBy("key", "part").agg(F.sum("count").alias("n")).filter(F.col("n") > crowd).select("key", "part")
    split = per_turn.join(crowds, ["key", "part"]).select("key", "part", "turn", F.ceil(F.col("count") / crowd).alias("pieces"))
    most = split.agg(F.max("pieces")).first()[0]
    if most:
        rows = rows.withColumn("id", F.monotonically_increasing_id()).join(split, ["key", "part", "turn"], "left")  # repeated rows part, too
        turn = F.when(F.col("pieces").isNotNull(), F.pmod("turn", F.lit(size))).otherwise(0)
        piece = F.when(F.col("pieces") > 1, F.pmod(F.xxhash64("id"), F.col("pieces"))).otherwise(0)
        rows = rows.withColumn("part", (F.col("part") * size + turn) * F.lit(int(most)) + piece)
    t = F.struct("turn", "line").alias("t")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(t)), lambda x: x["line"]), "\n")
    return rows.groupBy("key", "part").agg(F.first("conv_id").alias("conv_id"), text.alias("text")).select("conv_id", "part", "text")


def held_out(conversations: DataFrame):
    return (crc_text(conversations["conv_id"]) % 3) == 1


def format_chats(conversations: DataFrame) -> DataFrame:
    """The conversations' transcripts, parsed by a model fitted on the labelled ones whose crc32(conv_id) mod 3 isn't 1."""
    lines = marked_lines(conversations)
    out = parse(transcripts(lines), fit(lines.filter(~held_out(lines))))
    return out.withColumn("held_out", held_out(out))
