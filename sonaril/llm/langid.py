"""Language identification: word-first backoff.

A known word scores its log frequency in each language. A word unseen in training scores the mean
log frequency of its known character n-grams of the greatest length that has any (5 down to 1,
word ends marked). A text's language has the highest sum plus log prior; the score is its posterior.

The classifier learns every language that a row is labelled with, from a bounded sample: ``SAMPLE`` rows
of each language, those with the smallest hashes of id and text; rows whose hash is far from the smallest
are filtered where they are read, so that no task ranks a language's rows. All words and n-grams of
the sample are kept (only those a language has, not a table of units by languages), so the model
grows with the number of languages. Priors count all labelled rows.

Words are scored in bulk: units are found by their 64-bit hashes in sorted arrays, and each worker keeps
the rows of the words it has met, up to a fixed room.

Edges: ``und`` with score 0 for a null text or one without a letter, and for every text where no
labelled row exists; null or empty labels teach nothing; a null id counts as the empty text in the hash.
"""

from __future__ import annotations

import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonaril.llm.common import crc_text, free_names, prefix_hash, shuffle_partitions, span_hash, tidied, tidy

HASHED = 1 << 14  # units hashed at once
SAMPLE = 1500
ORDERS = (5, 4, 3, 2, 1)
_WORD = re.compile(r"[^\W\d_]+")
_MEMO = 200_000
#: doubles that a worker keeps of words met; words that are summed at once
ROOM, GROUP = 1 << 23, 1 << 15
#: different words that a task counts before it passes them on; rows that are taken out of Arrow at once
COUNTED, SLICE = 30_000, 512


def _grams(word: str, n: int) -> list[str]:
    w = f"_{word}_"
    return [w[i : i + n] for i in range(len(w) - n + 1)]


def _count_units(batches):
    """(lang, kind, unit, n) of a task's rows; kind 0: words, else the n-gram length."""
    held: dict[str, Counter] = {}

    def out():
        rows = []
        for lang, ws in held.items():
            kinds: list[Counter] = [ws, *(Counter() for _ in ORDERS)]
            for w, n in ws.items():
                for order in ORDERS:
                    for g in _grams(w, order):
                        kinds[order][g] += n
            rows += [(lang, k, u, n) for k, c in enumerate(kinds) for u, n in c.items()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.int64()))], names=["lang", "kind", "unit", "n"])

    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            held.setdefault(lang, Counter()).update(_WORD.findall((text or "").lower()))
        if sum(map(len, held.values())) > COUNTED:
            yield out()
            held = {}
    if held:
        yield out()


def _code_points(units: list[str], mark: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix hashes of all units laid end to end (between marks), and each unit's first and last-plus-one place."""
    text = mark + (mark + mark).join(units) + mark
    size = np.fromiter(map(len, units), np.int64, len(units)) + 2 * len(mark)
    end = np.cumsum(size)
    return prefix_hash(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)), end - size, end


class Units(NamedTuple):
    """Units of one kind: sorted hashes; from where to where a unit's entries stand; each entry's language and what it adds to
    ``base``, the languages' log frequency of a unit that they lack."""

    hashes: np.ndarray
    at: np.ndarray
    lang: np.ndarray
    add: np.ndarray
    base: np.ndarray

    @staticmethod
    def of(units: list[str], lang: np.ndarray, n: np.ndarray, langs: int) -> Units:
        # in slices, as a prefix hash and its powers take 24 bytes a letter
        each = [span_hash(*_code_points(units[k : k + HASHED])) for k in range(0, len(units), HASHED)]
        hashes, row = np.unique(np.concatenate([np.zeros(0, np.uint64), *each]), return_inverse=True)
        order = np.argsort(row, kind="stable")
        base = np.log(0.5 / (np.bincount(lang, n, langs) + 0.5 * len(hashes) + 1.0))
        return Units(hashes, np.searchsorted(row[order], np.arange(len(hashes) + 1)).astype(np.int32), lang[order].astype(np.int32), np.log((n[order] + 0.5) / 0.5).astype(np.float32), base)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each hash, and whether it is there."""
        if not len(self.hashes):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        i = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return i, self.hashes[i] == h

    def score(self, unit: np.ndarray, word: np.ndarray, words: int) -> np.ndarray:
        """Mean log frequency in each language of each word's units (indices ``unit`` of words ``word``)."""
        langs, count = len(self.base), self.at[unit + 1] - self.at[unit]
        e = np.repeat(self.at[unit] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        to = np.repeat(word, count) * langs + self.lang[e]
        more = np.bincount(to, self.add[e], words * langs).reshape(words, langs)
        return self.base + more / np.maximum(np.bincount(word, minlength=words), 1)[:, None]


class Model:
    """Languages, priors, and the units of each kind."""

    def __init__(self, langs: list[str], prior: list[float], units: pa.Table | None = None):
        """units: (lang, kind, unit, n); one kind's at a time are taken apart, so that the driver needs little more than the table."""
        self.langs, self.prior = langs, np.log(np.array(prior)) if langs else np.zeros(0)
        self.kinds: list[Units] = []
        for kind in range(6):
            if units is None:
                self.kinds.append(Units.of([], np.zeros(0, np.int64), np.zeros(0), len(langs)))
                continue
            own = units.filter(pc.equal(units["kind"], kind))
            lang = np.asarray(pc.index_in(own["lang"], pa.array(langs, pa.string()))).astype(np.int64)
            self.kinds.append(Units.of(own["unit"].to_pylist(), lang, np.asarray(own["n"]).astype(np.float64), len(langs)))

    def vectors(self, words: list[str]) -> np.ndarray:
        """Scores of words in each language: the word's, else those of its longest known n-grams, else zero."""
        out = np.zeros((len(words), len(self.langs)))
        s, first, end = _code_points(words)
        i, hit = self.kinds[0].find(span_hash(s, first, end))
        some = np.flatnonzero(hit)
        if len(some):
            out[some] = self.kinds[0].score(i[some], np.arange(len(some)), len(some))
        todo = np.flatnonzero(~hit)
        if len(todo):
            s, first, end = _code_points([words[k] for k in todo.tolist()], "_")
        for n in ORDERS:
            if not len(todo):
                break
            starts = np.maximum(end - first - n + 1, 0)
            word = np.repeat(np.arange(len(todo)), starts)
            at = np.arange(len(word)) - np.repeat(np.cumsum(starts) - starts, starts) + first[word]
            i, hit = self.kinds[n].find(span_hash(s, at, at + n))
            got, place = np.unique(word[hit], return_inverse=True)
            if len(got):
                out[todo[got]] = self.kinds[n].score(i[hit], place, len(got))
                left = np.ones(len(todo), bool)
                left[got] = False
                todo, first, end = todo[left], first[left], end[left]
        return out


class Scorer:
    """Keeps the rows of words met; all are dropped together when there are too many."""

    def __init__(self, model: Model):
        self.model = model
        self.cap = min(_MEMO, max(1 << 12, ROOM // max(1, len(model.langs))))
        self.rows: dict[str, int] = {}
        self.vec = np.zeros((self.cap, len(model.langs)))

    def sums(self, ws: list[str], at: np.ndarray) -> np.ndarray:
        """Sums of the words' scores between offsets ``at``."""
        new = set(ws).difference(self.rows)
        if len(self.rows) + len(new) > self.cap:
            self.rows.clear()
            new = set(ws)
        if new:
            fresh, used = list(new), len(self.rows)
            if used + len(fresh) > len(self.vec):
                self.vec = np.concatenate((self.vec[:used], np.zeros((len(fresh), self.vec.shape[1]))))
            for k in range(0, len(fresh), 1 << 12):
                self.vec[used + k : used + k + (1 << 12)][: len(fresh) - k] = self.model.vectors(fresh[k : k + (1 << 12)])
            self.rows.update(zip(fresh, range(used, used + len(fresh)), strict=True))
        idx = np.fromiter(map(self.rows.__getitem__, ws), np.int64, len(ws))
        out = np.zeros((len(at) - 1, self.vec.shape[1]))
        full = np.flatnonzero(np.diff(at))
        if len(full):
            out[full] = np.add.reduceat(self.vec[idx], at[:-1][full], axis=0)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and posterior of each text."""
        m = self.model
        total = np.zeros((len(texts), len(m.langs))) + m.prior
        ws: list[str] = []
        ends, owners = [0], []

        def flush():
            nonlocal ws, ends, owners
            np.add.at(total, owners, self.sums(ws, np.array(ends)))
            ws, ends, owners = [], [0], []

        some = np.array([bool(t) and bool(m.langs) and any(map(str.isalpha, t)) for t in texts], bool)
        for i in np.flatnonzero(some).tolist():
            found = _WORD.findall(texts[i].lower())
            for k in range(0, len(found), GROUP):
                ws += found[k : k + GROUP]
                ends.append(len(ws))
                owners.append(i)
                if len(ws) >= GROUP:
                    flush()
        if owners:
            flush()
        if not m.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        best = total.argmax(1)
        score = 1.0 / np.exp(total - total[np.arange(len(texts)), best][:, None]).sum(1)
        return [m.langs[b] if s else "und" for b, s in zip(best.tolist(), some.tolist(), strict=True)], np.where(some, score, 0.0)


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from (doc_id, text, lang) rows; nothing else of them is read."""
    spark = labelled.sparkSession
    rows = labelled.filter(F.col("lang").isNotNull() & (F.col("lang") != "") & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    per = rows.groupBy("lang").count().collect()  # a row a language
    if not per:
        return Model([], [])
    names = sorted(r["lang"] for r in per)
    seen = {r["lang"]: r["count"] for r in per}
    # of each language the rows with hashes below a bound that about half as many more as the sample reach; of those, the smallest
    bound = spark.createDataFrame([(x, float(min(1.0, (1.5 * sample + 100) / n))) for x, n in seen.items()], "lang string, share double")
    key = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text"), 11)
    near = rows.withColumn("key", key).join(F.broadcast(bound), "lang").filter(F.col("key") <= F.col("share") * F.lit(float(1 << 53)))
    ranked = near.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("key", "doc_id", "text")))
    taken = ranked.filter(F.col("r") <= sample).repartition(shuffle_partitions(spark), "lang", "r").select("lang", "text")
    counts = taken.mapInArrow(tidied(_count_units), "lang string, kind int, unit string, n long").groupBy("lang", "kind", "unit").agg(F.sum("n").alias("n"))
    got = counts.toArrow()  # the units of ``sample`` rows a language
    total = sum(seen.values())
    model = Model(names, [seen[x] / total for x in names], got)
    del got
    tidy()  # what building took goes back to the system
    return model


def predict(docs: DataFrame, model: Model, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the language and its posterior in columns of these names (which replace such columns)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name not in names)
    docs = docs.drop(*names)
    at = docs.columns.index(text_col)

    def run(batches):
        score = Scorer(shared.value)
        for b in (x.slice(i, SLICE) for x in batches for i in range(0, x.num_rows, SLICE)):
            langs, posterior = score.predict(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(posterior, pa.float64())], names=[*b.schema.names, *names])

    return docs.mapInArrow(tidied(run), f"{schema}, `{names[0]}` string, `{names[1]}` double")


def held_out(docs: DataFrame, mod: int = 3, rest: int = 1):
    return (crc_text(docs["doc_id"]) % mod) == rest


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document, learning from those that are not held out."""
    model = fit(docs.filter(~held_out(docs)))
    ids = docs.select("doc_id", "text", held_out(docs).alias("held_out"))
    return predict(ids, model).select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Pipeline stage: documents with a language of posterior ``least`` or more stay."""
    found, posterior = free_names(docs, "found", "posterior")
    kept = predict(docs, fit(docs), names=(found, posterior))
    return kept.filter((F.col(found) != "und") & (F.col(posterior) >= least)).select(*[F.col(f"`{c}`") for c in docs.columns])
