"""Language-model scoring by a hashed maximum-entropy model.

The next token's probability is factored into its class and the token within the class, each a softmax
over hashed features of the history: the token before, skips of one and two, and the pair of tokens
before. The most frequent training tokens (``OWN``) have classes of their own; every other token belongs to one
of ``REST`` classes by its last two bytes (endings go together in most languages), within which it has
add-one unigram probability, so the whole is a distribution over known tokens and one unseen token of each
rest class. In the history a frequent token stands for itself and another one for its ending; pairs
are of the tokens themselves. Feature rows are found by hash; their number grows with the training
tokens, by a factor of two for every 64 times as many.

Training passes once over every training text, in ``ROUNDS`` parts: in each, every task starts from
the shared weights, takes gradient steps (AdaGrad) over its texts and sends its change; the changes,
weighted by tokens, are summed block by block on the cluster and give the next weights. (So scores depend, a little, on
how the texts are dealt to tasks.)

Counts cover every training token: the frequent ones (at most ``HEAD``) are broadcast, the
others are joined by token hash. Tokens are told apart by 61-bit hashes, beside three bits of their class.

Edges: null or empty text is the end token alone; without training rows nothing is known, N and V are
0 and the score is the base score; repeated rows and null ids are scored as rows of their own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonaril.llm.common import Scratch, crc_text, lower_ascii, mix, prefix_hash, span_hash, text_chunks, words

CLASSES, REST, SIZE = 32, 8, 32
OWN = (CLASSES - REST) * SIZE
HEAD = 1 << 18
LEAST_ROWS, PER_CLASS_ROW = 1 << 12, 4
ROUNDS, BATCH, RATE = 3, 1 << 14, 0.15
_LOW = np.uint64((1 << 61) - 1)
_START = np.uint64(1 << 40)
_BLOCK = 1 << 15


# --------------------------------------------------------------------------- tokens
def _classed(h: np.ndarray, ending: np.ndarray) -> np.ndarray:
    """Hashes whose top three bits are the rest class of the token's ending."""
    return (h & _LOW) | (mix(ending.astype(np.uint64)) & ~_LOW)


END = _classed(np.array([0x5E1D0F7E9B3C2A41], np.uint64), np.zeros(1, np.uint64))[0]


def tokens_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and endings (last two bytes) of all documents' tokens, each document followed by its end token, and n + 1 offsets."""
    low = lower_ascii(data)
    start, stop, doc = words(low, offs)
    last = low[stop - 1].astype(np.uint16)
    ending = last * np.uint16(256) + np.where(stop - start > 1, low[np.maximum(stop - 2, 0)], 0).astype(np.uint16)
    n = len(offs) - 1
    at = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=n) + 1)))
    h, tail = np.full(at[-1], END, np.uint64), np.zeros(at[-1], np.uint16)
    body = np.ones(at[-1], bool)
    body[at[1:] - 1] = False
    h[body], tail[body] = _classed(span_hash(prefix_hash(low), start, stop), ending), ending
    return h, tail, at


def _count(batches):
    """(h, n) of a task's tokens, merged in memory up to two million entries at a time."""
    hs: list[np.ndarray] = []
    ns: list[np.ndarray] = []

    def merged():
        h, n = np.concatenate(hs), np.concatenate(ns)
        u, inv = np.unique(h, return_inverse=True)
        return u, np.bincount(inv, weights=n).astype(np.int64)

    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        for _, data, offs in text_chunks(b):
            u, n = np.unique(tokens_of(data, offs)[0], return_counts=True)
            hs.append(u)
            ns.append(n)
            size += len(u)
            if size > 2_000_000:
                u, n = merged()
                hs, ns, size = [u], [n], len(u)
                if size > 1_500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n)], names=["h", "n"])
                    hs, ns, size = [], [], 0
    if hs:
        u, n = merged()
        yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n)], names=["h", "n"])


# --------------------------------------------------------------------------- the model
class Weights:
    """Class and token tables of ``rows`` and ``PER_CLASS_ROW`` times as many rows; ``flat`` is both, end to end."""

    def __init__(self, rows: int, flat: np.ndarray | None = None):
        n = rows * CLASSES
        self.rows = rows
        self.flat = np.zeros(n + rows * PER_CLASS_ROW * SIZE, np.float32) if flat is None else flat
        self.cls, self.tok = self.flat[:n].reshape(-1, CLASSES), self.flat[n:].reshape(-1, SIZE)


class Vocabulary:
    """Frequent tokens: sorted hashes, counts, and the model's id of each (0: it has none of its own)."""

    def __init__(self, h: np.ndarray, c: np.ndarray, rest_c: np.ndarray, rest_n: np.ndarray):
        """h, c: by falling count; rest_c, rest_n: the counts and the number of all tokens with each class's endings."""
        self.total, self.distinct = int(rest_c.sum()), int(rest_n.sum())
        own = min(len(h), OWN)
        ids = np.zeros(len(h), np.int64)
        ids[:own] = np.arange(1, own + 1)
        order = np.argsort(h)
        self.h, self.c, self.ids = h[order], c[order], ids[order]
        bucket = (h[:own] >> np.uint64(61)).astype(np.int64)
        left_c, left_n = rest_c - np.bincount(bucket, c[:own], REST), rest_n - np.bincount(bucket, minlength=REST)
        mass = np.zeros(OWN)
        mass[:own] = c[:own]
        in_class = mass.reshape(-1, SIZE)
        cls = np.concatenate((left_c, in_class.sum(1))) + 0.5
        self.class_bias = np.log(cls / cls.sum()).astype(np.float32)
        inner = np.where((np.arange(OWN) >= own).reshape(-1, SIZE), 1e-9, in_class + 0.5)
        inner = np.concatenate((np.ones((REST, SIZE)), inner))
        self.token_bias = np.log(inner / inner.sum(1, keepdims=True)).astype(np.float32)
        #: what the tokens of a rest class share: their counts plus one each, and one unseen token
        self.rest_log = np.log10(left_c + left_n + 1)
        self.rows = LEAST_ROWS << max(0, round((math.log2(max(self.total, 1)) - 22) / 6))

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index in the sorted hashes, and whether the token is there."""
        if not len(self.h):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        i = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return i, self.h[i] == h

    def own_ids(self, i: np.ndarray, known: np.ndarray) -> np.ndarray:
        return np.where(known, self.ids[i], 0) if len(self.ids) else np.zeros(len(i), np.int64)

    def classes(self, h: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class of every token, and its place there (of tokens with an id)."""
        return np.where(ids > 0, REST + (ids - 1) // SIZE, (h >> np.uint64(61)).astype(np.int64)), (ids - 1) % SIZE

    def histories(self, h: np.ndarray, tail: np.ndarray, ids: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """Feature rows of every position: the token before, skips of one and two, the pair before."""
        n, mask = len(h), np.uint64(self.rows - 1)
        place = np.arange(n) - np.repeat(at[:-1], np.diff(at))
        seen = np.where(ids > 0, ids, tail.astype(np.int64) + (1 << 20)).astype(np.uint64)

        def before(x: np.ndarray, k: int) -> np.ndarray:
            p = np.full(n, _START)
            p[k:] = x[:-k]
            p[place < k] = _START
            return p

        rows = [mix(before(seen, k) + np.uint64(k << 41)) & mask for k in (1, 2, 3)]
        rows.append(mix(before(h, 1) * np.uint64(0x9E3779B97F4A7C15) + before(h, 2)) & mask)
        return [r.astype(np.int32) for r in rows]


def _token_rows(rows: list[np.ndarray], cls: np.ndarray, size: int) -> list[np.ndarray]:
    return [((r.astype(np.int64) * 2654435761 + cls * 97531 + k * 7919) >> 5 & (size - 1)).astype(np.int32) for k, r in enumerate(rows)]


def _softmax(z: np.ndarray) -> np.ndarray:
    z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(1, keepdims=True)
    return z


def _scatter(table: np.ndarray, acc: np.ndarray, rows: np.ndarray, g: np.ndarray) -> None:
    """One AdaGrad step on the rows' summed gradients."""
    order = np.argsort(rows.astype(np.uint16) if len(table) <= 1 << 16 else rows, kind="stable")
    r = rows[order]
    first = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
    s = np.add.reduceat(g[order], first, axis=0)
    r = r[first]
    acc[r] += s * s
    table[r] -= RATE * s / np.sqrt(acc[r] + 1e-6)


class Trainer:
    def __init__(self, vocab: Vocabulary, flat: np.ndarray):
        self.vocab, self.start, self.w, self.acc = vocab, flat, Weights(vocab.rows, flat.copy()), Weights(vocab.rows)
        self.acc.flat[:] = 1.0
        self.seen = 0

    def step(self, rows: list[np.ndarray], cls: np.ndarray, inner: np.ndarray) -> None:
        v, w = self.vocab, self.w
        z = v.class_bias + w.cls[rows[0]]
        for r in rows[1:]:
            z += w.cls[r]
        p = _softmax(z)
        p[np.arange(len(cls)), cls] -= 1
        own = np.flatnonzero(cls >= REST)
        self.seen += len(cls)
        cls, inner = cls[own], inner[own]
        trows = _token_rows([r[own] for r in rows], cls, len(w.tok))
        z = v.token_bias[cls]
        for r in trows:
            z += w.tok[r]
        q = _softmax(z)
        q[np.arange(len(own)), inner] -= 1
        for r in rows:
            _scatter(w.cls, self.acc.cls, r, p)
        if len(own):
            for r in trows:
                _scatter(w.tok, self.acc.tok, r, q)

    def learn(self, data: np.ndarray, offs: np.ndarray) -> None:
        h, tail, at = tokens_of(data, offs)
        ids = self.vocab.own_ids(*self.vocab.look_up(h))
        rows = self.vocab.histories(h, tail, ids, at)
        cls, inner = self.vocab.classes(h, ids)
        for k in range(0, len(ids), BATCH):
            self.step([r[k : k + BATCH] for r in rows], cls[k : k + BATCH], inner[k : k + BATCH])


def log_probs(vocab: Vocabulary, w: Weights, rows: list[np.ndarray], cls: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """Natural log probability of every position's class and, where the class is of frequent tokens, of its token."""
    out = np.zeros(len(cls))
    for k in range(0, len(cls), BATCH):
        sub, part = cls[k : k + BATCH], [r[k : k + BATCH] for r in rows]
        z = vocab.class_bias + w.cls[part[0]]
        for r in part[1:]:
            z += w.cls[r]
        m = z.max(1)
        lp = z[np.arange(len(sub)), sub] - m - np.log(np.exp(z - m[:, None]).sum(1))
        own = np.flatnonzero(sub >= REST)
        trows = _token_rows([r[own] for r in part], sub[own], len(w.tok))
        z = vocab.token_bias[sub[own]]
        for r in trows:
            z += w.tok[r]
        m = z.max(1, initial=-np.inf)
        lp[own] += z[np.arange(len(own)), inner[k : k + BATCH][own]] - m - np.log(np.exp(z - m[:, None]).sum(1))
        out[k : k + BATCH] = lp
    return out


# --------------------------------------------------------------------------- jobs
def held_out(docs: DataFrame):
    return (crc_text(docs["doc_id"]) % 7) == 2


def count_tokens(train: DataFrame, tmp: Scratch) -> tuple[DataFrame, Vocabulary]:
    """Counts (h, c) of every training token as a table, and the vocabulary of the frequent ones."""
    counts = tmp.table(train.select("text").mapInArrow(_count, "h long, n long").groupBy("h").agg(F.sum("n").alias("c")), "counts")
    rest_c, rest_n = np.zeros(REST), np.zeros(REST)
    for r in counts.groupBy(F.shiftrightunsigned("h", 61).alias("b")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():  # a row a class
        rest_c[r["b"]], rest_n[r["b"]] = r["c"], r["n"]
    # the frequent tokens are those above a count that no more than HEAD reach, found from a histogram of 64 bins an octave
    octave = F.floor(F.log2("c") * 64)
    bins = {r["bin"]: r["k"] for r in counts.groupBy(octave.alias("bin")).agg(F.count("*").alias("k")).collect()}  # 64 * 63 rows at most
    least, held = None, 0
    for bin_ in sorted(bins, reverse=True):
        if held + bins[bin_] > HEAD:
            break
        least, held = bin_, held + bins[bin_]
    if bins and held < OWN:  # more tokens are about equally frequent than that: the model's own are the first of them by count and hash
        some = counts.orderBy(F.desc("c"), "h").limit(OWN)
    else:
        some = counts.filter(octave >= (least if least is not None else 0))
    top = some.toArrow().to_pandas().sort_values(["c", "h"], ascending=[False, True])
    return counts, Vocabulary(top["h"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.float64), rest_c, rest_n)


def train_weights(train: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS) -> Weights:
    spark = train.sparkSession
    sc = spark.sparkContext
    shared = sc.broadcast(vocab)
    w = Weights(vocab.rows)
    for part in range(rounds):
        now = sc.broadcast(w.flat)

        def run(batches, now=now):
            from pyspark import TaskContext

            t = Trainer(shared.value, now.value)
            for b in batches:
                if b.num_rows:
                    for _, data, offs in text_chunks(b):
                        t.learn(data, offs)
            if t.seen:
                change = (t.w.flat - t.start) * np.float32(t.seen)
                n = -(-len(change) // _BLOCK)
                yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([TaskContext.get().partitionId()] * n, pa.int32()), pa.array([t.seen] * n, pa.int64()), pa.array([change[i * _BLOCK : (i + 1) * _BLOCK].tobytes() for i in range(n)], pa.binary())], names=["block", "task", "n", "change"])

        def add(batches):
            held: dict[int, list] = {}
            for b in batches:
                for block, n, change in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                    x = np.frombuffer(change, np.float32).astype(np.float64)
                    if block in held:
                        held[block][0] += n
                        held[block][1] += x
                    else:
                        held[block] = [n, x]
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([(x / n).astype(np.float32).tobytes() for n, x in held.values()], pa.binary())], names=["block", "change"])

        mine = train.filter(F.pmod(F.xxhash64("text"), F.lit(rounds)) == part).select("text")
        changes = mine.mapInArrow(run, "block int, task int, n long, change binary")
        summed = changes.repartition("block").sortWithinPartitions("block", "task").mapInArrow(add, "block int, change binary")
        flat = w.flat.copy()
        for r in summed.collect():  # the model's own fixed size
            flat[r["block"] * _BLOCK : (r["block"] + 1) * _BLOCK] += np.frombuffer(r["change"], np.float32)
        w = Weights(vocab.rows, flat)
        now.unpersist()
    return w


_DOC = "doc_id long, rid long, held_out boolean, n_tokens long, known long, base double, lm double, tail_h array<long>, tail_n array<int>"


def _score_kernel(vocab: Vocabulary, w: Weights):
    from pyarrow import ListArray

    def kernel(b):
        for part, data, offs in text_chunks(b):
            h, tail, at = tokens_of(data, offs)
            i, known = vocab.look_up(h)
            ids = vocab.own_ids(i, known)
            cls, inner = vocab.classes(h, ids)
            lc = np.where(known, np.log10((vocab.c[i] if len(vocab.c) else 0.0) + 1.0), 0.0)
            lm = log_probs(vocab, w, vocab.histories(h, tail, ids, at), cls, inner) / math.log(10)
            lm += np.where(ids == 0, lc - vocab.rest_log[np.minimum(cls, REST - 1)], 0.0)
            sums = [np.add.reduceat(x, at[:-1]) for x in (known.astype(np.int64), lc, lm)]
            doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
            far = np.flatnonzero(~known)
            # tokens beyond the broadcast ones: each distinct one of a document, with its number
            order = far[np.lexsort((h[far], doc[far]))]
            d, x = doc[order], h[order]
            new = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (x[1:] != x[:-1])))) if len(order) else np.zeros(0, np.int64)
            cut = pa.array(np.searchsorted(d[new], np.arange(part.num_rows + 1)).astype(np.int32))
            lists = [ListArray.from_arrays(cut, pa.array(x[new].view(np.int64))), ListArray.from_arrays(cut, pa.array(np.diff(np.append(new, len(order))).astype(np.int32)))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(np.diff(at)), pa.array(sums[0]), pa.array(sums[1]), pa.array(sums[2]), *lists], names=[f.split()[0] for f in _DOC.split(", ")])

    return kernel


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    tmp = Scratch(docs.sparkSession, "maxent")
    sc = docs.sparkSession.sparkContext
    train = docs.filter(~held_out(docs))
    counts, vocab = count_tokens(train, tmp)
    w = train_weights(train, vocab)
    shared = sc.broadcast((vocab, w))

    def run(batches):
        kernel = _score_kernel(*shared.value)
        for b in batches:
            if b.num_rows:
                yield from kernel(b)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("rid"), held_out(docs).alias("held_out"), "text")
    near = tmp.table(rows.mapInArrow(run, _DOC), "near")
    far = near.select("rid", F.explode(F.arrays_zip("tail_h", "tail_n")).alias("t")).select("rid", F.col("t.tail_h").alias("h"), F.col("t.tail_n").alias("n"))
    more = far.join(counts, "h").groupBy("rid").agg(F.sum("n").alias("more_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("more"))
    add = F.coalesce(F.col("more"), F.lit(0.0))
    norm = math.log10(vocab.total + vocab.distinct + 1)
    base = F.col("base") + add - F.col("n_tokens") * F.lit(norm)
    out = near.join(more, "rid", "left")
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"), F.lit(vocab.total).cast("long").alias("train_tokens"), base.alias("base_score"), (base if not vocab.total else F.col("lm") + add).alias("score"))
