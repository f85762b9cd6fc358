"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Features of a text: its words hashed to ``2**bits`` places (values of log counts, scaled to length one), statistics of
its structure and its length column, each in one of ``BINS`` bins. The score is
``sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i (v_if x_i)^2))``, linear in the features.

The model learns from at most ``sample`` labelled rows (chosen by a hash of their id), so driver memory does not grow with
the data; statistics and scores always take whole texts. Null and empty texts have no words and the statistics of nothing,
and get a score like any other. A null label is no label. Of repeated rows each is scored; an id labelled twice counts
twice. Without labelled rows the score is 0.5. A score at the threshold counts as label 1. Very long texts are read whole, one at a time. Extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import text_slices

BINS = 24
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_MARK = np.isin(np.arange(256), [ord(c) for c in ".,;:!?'\"()-"])
_SYMBOL = (np.arange(256) > 32) & (np.arange(256) < 127) & ~_MARK & ~_DIGIT & ~np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])
STATISTICS = 12


def statistics(text: str, words: list[str]) -> list[int]:
    """Bins of whole-text statistics."""
    ratio = lambda part, whole: min(BINS - 1, int(BINS * math.sqrt(part / whole))) if whole else 0
    size = lambda x: min(BINS - 1, int(1.5 * math.log2(1 + x)))
    at = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    n, total = len(words), int(at.sum())
    lines = text.split("\n")
    codes = np.fromiter(map(hash, words), np.int64, n)  # compared with each other only
    triples = codes[:-2] * 3 + codes[1:-1] * 5 + codes[2:] * 7
    return [
        size(n), size(total), ratio(at[_UPPER].sum(), total), ratio(at[_DIGIT].sum(), total), ratio(at[_SYMBOL].sum(), total), ratio(at[ord("!")], n),
        ratio(at[_MARK].sum(), n * 2), ratio(at[ord("|")], n), size(total / n if n else 0), ratio(len(lines) - len(set(lines)), len(lines)),
        ratio(len(triples) - len(np.unique(triples)), len(triples)), ratio(n - len(np.unique(codes)), n),
    ]


def features(text: str | None, length: float | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values."""
    text = text or ""
    words = text.split()
    counts = Counter(words)
    mask = (1 << bits) - 1
    place = [zlib.crc32(w.encode()) & mask for w in counts]
    value = 1 + np.log(np.fromiter(counts.values(), np.float64, len(counts)))
    value /= max(1e-9, math.sqrt(float(value @ value)))
    bins = statistics(text, words)
    bins.append(BINS - 1 if length is None or length < 0 else min(BINS - 2, int(1.5 * math.log2(1 + length))))
    place += [mask + 1 + i * BINS + b for i, b in enumerate(bins)]
    return np.array(place, np.int64), np.concatenate((value, np.ones(len(bins))))


@dataclass
class FactorisationMachine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def raw(self, place: np.ndarray, value: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the sigmoid, and the factor sums, of rows whose non-empty features begin at begin."""
        vx = self.factors[place] * value[:, None]
        sums = np.add.reduceat(vx, begin)
        pairs = 0.5 * (sums**2 - np.add.reduceat(vx * vx, begin)).sum(axis=1)
        return self.bias + np.add.reduceat(self.linear[place] * value, begin) + pairs, sums

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        sizes = [len(p) for p, _ in rows]
        y, _ = self.raw(np.concatenate([p for p, _ in rows]), np.concatenate([v for _, v in rows]), np.cumsum([0, *sizes[:-1]]))
        return 1 / (1 + np.exp(-np.clip(y, -30, 30)))


def _loss(m: FactorisationMachine, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> float:
    p = np.clip(m.score(rows), 1e-9, 1 - 1e-9)
    return float(-np.where(labels > 0, np.log(p), np.log(1 - p)).mean())


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, bits: int, rank: int = 4, rate: float = 0.1, decay: float = 1e-4, batch: int = 128, steps: int = 50, most_steps: int = 600, gain: float = 0.05) -> FactorisationMachine:
    """Adagrad on the log loss, until the loss of every fifth row, which it does not learn from, has not fallen by gain for three times steps."""
    rng = np.random.default_rng(7)
    n = (1 << bits) + (STATISTICS + 1) * BINS
    m = FactorisationMachine(0.0, np.zeros(n), rng.normal(0, 0.01, (n, rank)))
    seen_w, seen_v, seen_b = np.full(n, 1e-2), np.full((n, rank), 1e-2), 1e-2
    aside = np.arange(len(rows)) % 5 == 4
    watched, watched_labels = [r for r, x in zip(rows, aside, strict=True) if x], labels[aside]
    learned = np.flatnonzero(~aside)
    order, best, waits = np.zeros(0, np.int64), math.inf, 0
    for step in range(1, most_steps + 1 if len(learned) else 1):
        if not len(order):
            order = rng.permutation(learned)
        own, order = order[:batch], order[batch:]
        sizes = np.array([len(rows[j][0]) for j in own])
        place, value = np.concatenate([rows[j][0] for j in own]), np.concatenate([rows[j][1] for j in own])
        y, sums = m.raw(place, value, np.cumsum(sizes) - sizes)
        off = (1 / (1 + np.exp(-np.clip(y, -30, 30))) - labels[own]) / len(own)
        row = np.repeat(np.arange(len(own)), sizes)
        part = (off[row] * value)[:, None]
        used, where = np.unique(place, return_inverse=True)
        grad_w = np.bincount(where, part[:, 0], len(used)) + decay * m.linear[used]
        each = part * (sums[row] - m.factors[place] * value[:, None])
        grad_v = np.stack([np.bincount(where, each[:, f], len(used)) for f in range(rank)], axis=1) + decay * m.factors[used]
        seen_w[used] += grad_w**2
        seen_v[used] += grad_v**2
        seen_b += off.sum() ** 2
        m.linear[used] -= rate * grad_w / np.sqrt(seen_w[used])
        m.factors[used] -= rate * grad_v / np.sqrt(seen_v[used])
        m.bias -= rate * off.sum() / math.sqrt(seen_b)
        if step % steps == 0 and watched:
            now = _loss(m, watched, watched_labels)
            best, waits = (now, 0) if now < (1 - gain) * best else (best, waits + 1)
            if waits == 3:
                break
    return m


def held_out(key: Column, folds: int = 5) -> Column:
    return F.crc32(key.cast("string")) % folds == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = 4000, bits: int = 16, label: str = "quality", text: str = "text", key: str = "doc_id", length: str = "n_chars") -> FactorisationMachine:
    """Fit on at most sample labelled rows that are not held out."""
    chosen = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key))).select(F.col(key), F.col(label).alias("_label"))
    chosen = chosen.orderBy(F.xxhash64(F.col(key)), key, "_label").limit(sample)  # so few rows that they can be broadcast
    own = docs.select(key, text, _length(docs, length)).join(F.broadcast(chosen), key)
    schema = T.StructType([docs.schema[key], T.StructField("label", T.DoubleType()), T.StructField("place", T.ArrayType(T.LongType())), T.StructField("value", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, text):
            made = [features(t, n, bits) for t, n in zip(b.column(text).to_pylist(), b.column("_length").to_pylist(), strict=True)]
            yield pa.record_batch([b.column(key), b.column("_label").cast(pa.float64()), pa.array([p for p, _ in made], pa.list_(pa.int64())), pa.array([v for _, v in made], pa.list_(pa.float64()))], schema.names)

    rows = own.mapInArrow(run, schema).toArrow().sort_by([(key, "ascending"), ("label", "ascending")])
    made = [(np.asarray(p), np.asarray(v)) for p, v in zip((x.values.to_numpy() for x in rows["place"]), (x.values.to_numpy() for x in rows["value"]), strict=True)]
    return fit(made, (rows["label"].to_numpy() > 0).astype(float), bits)


def _length(docs: DataFrame, length: str) -> Column:
    return (F.col(length).cast("double") if length in docs.columns else F.lit(None).cast("double")).alias("_length")


def score(docs: DataFrame, model: FactorisationMachine, bits: int = 16, text: str = "text", key: str = "doc_id", length: str = "n_chars") -> DataFrame:
    """(key, score) of every row."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # its size is set by bits and rank
    schema = T.StructType([docs.schema[key], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, text):
            rows = [features(t, n, bits) for t, n in zip(b.column(text).to_pylist(), b.column("_length").to_pylist(), strict=True)]
            yield pa.record_batch([b.column(key), pa.array(shipped.value.score(rows), pa.float64())], schema.names)

    return docs.select(key, text, _length(docs, length)).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = 4000, key: str = "doc_id") -> DataFrame:
    """(key, held_out, score, predicted) of every row."""
    scored = score(docs, train(docs, labels, sample, key=key), key=key)
    return scored.select(key, F.coalesce(held_out(F.col(key)), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = 4000, text: str = "text", key: str = "doc_id", length: str = "n_chars", bits: int = 16) -> DataFrame:
    """The rows of docs whose score reaches the threshold, all columns kept; scored where they are read."""
    shipped = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample, bits=bits, text=text, key=key, length=length))
    has_length = length in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, text):
            sizes = b.column(length).cast(pa.float64()).to_pylist() if has_length else [None] * b.num_rows
            rows = [features(t, n, bits) for t, n in zip(b.column(text).to_pylist(), sizes, strict=True)]
            yield b.filter(pa.array(shipped.value.score(rows) >= threshold))

    return docs.mapInArrow(run, docs.schema)
