"""Toxicity scores by FTRL-proximal logistic regression.

Features are hashed word unigrams, bigrams and skip-grams (a word and the next but one), present or not.
Learning is the per-coordinate FTRL-proximal update with L1 and L2 terms over a bounded sample of labelled
texts; L1 leaves few weights other than 0, which are broadcast as (index, value).

Edge cases: null and empty texts get the score of the bias alone; without labels every score is 0; a
label that is null teaches nothing, of several labels of one id each teaches; texts are read whole.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, crc_fold
from .ngrams import mix, words

BITS = 20
#: Learning reads at most so many labelled texts (the bound on what its one task holds).
SAMPLE = 12_000
EPOCHS = 6
#: Learning looks at features that so many texts of the sample have.  Features are hashed for so many bytes of text at a
#: time: a word costs many times its own bytes of memory.
MIN_TEXTS, BLOCK_BYTES = 2, 1 << 18
ALPHA, BETA, L1, L2 = 4.0, 1.0, 4.0, 1.0
THRESHOLD = 0.7
FOLDS, HELD_OUT = 3, 1


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all features and the text of each; repeats included."""
    h, doc = words(texts)
    shift = np.uint64(64 - BITS)
    parts = [(h >> shift, doc)]
    for gap, seed in ((1, 0x1B873593), (2, 0x85EBCA6B)):
        if len(h) > gap:
            same = doc[gap:] == doc[:-gap]
            parts.append((mix(h[:-gap] * np.uint64(seed) + h[gap:])[same] >> shift, doc[gap:][same]))
    return np.concatenate([p[0] for p in parts]).astype(np.int64), np.concatenate([p[1] for p in parts])


def _rows(texts: list[bytes]):
    """The distinct features of each text."""
    for first, end in chunks(texts, BLOCK_BYTES):
        idx, doc = features(texts[first:end])
        idx, doc = idx[np.argsort(doc, kind="stable")], np.sort(doc)
        cut = np.searchsorted(doc, np.arange(end - first + 1))
        for i in range(end - first):
            yield np.unique(idx[cut[i] : cut[i + 1]])


def learn(texts: list[bytes], labels: list[int], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """Indices and values of the weights other than 0, and the bias."""
    return fit([row.astype(np.int32) for row in _rows(texts)], labels, epochs)


def packed(row: np.ndarray) -> bytes:
    """Ascending features in two bytes each: how many there are for each of the upper bits, then the lower 16 of all."""
    return np.bincount(row >> 16, minlength=1 << BITS - 16).astype("<u4").tobytes() + (row & 0xFFFF).astype("<u2").tobytes()


def unpacked(data) -> np.ndarray:
    n = 4 << BITS - 16
    return np.repeat(np.arange(1 << BITS - 16, dtype=np.int32) << 16, np.frombuffer(data, "<u4", n // 4)) | np.frombuffer(data, "<u2", offset=n)


class Packed:
    """Rows of features that are unpacked one at a time, as often as they are read."""

    def __init__(self, rows: list):
        self.rows = rows

    def __iter__(self):
        return map(unpacked, self.rows)


def fit(rows, labels: list[int], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """The same from the distinct features of each text."""
    seen = np.zeros(1 << BITS, np.int32)
    for row in rows:
        seen[row] += 1
    rows = [row[seen[row] >= MIN_TEXTS] for row in rows]
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    bias = 1 << BITS
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at = np.append(rows[i], bias)
            zi, ni = z[at], n[at]
            w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2)
            w[np.abs(zi) <= L1] = 0
            w[-1] = -zi[-1] / ((BETA + np.sqrt(ni[-1])) / ALPHA)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - labels[i]
            step = np.sqrt(ni + g * g) - np.sqrt(ni)
            z[at] += g - step / ALPHA * w
            n[at] += g * g
    w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
    w[np.abs(z) <= L1] = 0
    b = -z[bias] / ((BETA + np.sqrt(n[bias])) / ALPHA)
    idx = np.flatnonzero(w[:bias])
    return idx.astype(np.int32), w[idx].astype(np.float32), float(b)


def sample(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """(id, text, toxic): the whole texts of at most ``bound`` labels of the learning folds, chosen by a hash of the id."""
    rows = labels.where(F.col("toxic").isNotNull() & (crc_fold(F.col("doc_id"), FOLDS) != HELD_OUT)).select("doc_id", "toxic")
    total = rows.count()
    draw = (F.xxhash64("doc_id") % 1_000_000 + 1_000_000) % 1_000_000
    rows = rows.where(draw < int(1_000_000 * min(1.0, 0.95 * bound / total if total > bound else 1.0)) + 1)
    got = docs.select("doc_id", "text").join(F.broadcast(rows.limit(bound)), "doc_id")
    return got.select(F.col("doc_id").cast("string").alias("id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"), F.col("toxic").cast("int").alias("toxic"))


def probabilities(texts: list[bytes], weight: np.ndarray, bias: float) -> np.ndarray:
    """Score of each text; ``weight`` is dense."""
    out = np.zeros(len(texts))
    for first, end in chunks(texts, BLOCK_BYTES):
        at, doc = features(texts[first:end])
        hit = np.flatnonzero(weight[at])  # few: most weights are 0
        pair = np.unique((doc[hit].astype(np.int64) << BITS) | at[hit])
        total = np.bincount(pair >> BITS, weight[pair & ((1 << BITS) - 1)].astype(np.float64), end - first)
        out[first:end] = 1 / (1 + np.exp(-np.clip(total + bias, -35, 35)))
    return out


def _scored(docs: DataFrame, model, emit, schema) -> DataFrame:
    """Run ``emit(batch, scores)`` over the batches of ``docs``; scores are 0 where nothing was learned."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        if shared.value:
            idx, val, bias = shared.value
            weight = np.zeros(1 << BITS, np.float32)
            weight[idx] = val
        for b in batches:
            texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in b.column(at).cast(pa.binary())]
            yield emit(b, probabilities(texts, weight, bias) if shared.value else np.zeros(len(texts)))

    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))).mapInArrow(run, schema)  # by place: names may hold dots


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float] | None) -> DataFrame:
    """doc_id, held_out, score, predicted for every whole text."""

    def emit(b, out):
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out), pa.array((out >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", (crc_fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "text")
    return _scored(rows, model, emit, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, score double, predicted int")


def train(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Weights learned from the bounded sample: features where the texts lie, the fit in one executor task.

    That task holds the features of ``bound`` texts; the driver only gets the few weights that are not 0.
    """

    def hashed(batches):
        for b in batches:
            rows = [packed(r) for r in _rows(b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(rows, pa.binary()), b.column("toxic")], ["id", "row", "toxic"])

    def run(batches):
        rows = [r for b in batches for r in zip(b.column("id").to_pylist(), (x.as_buffer() for x in b.column("row")), b.column("toxic").to_pylist(), strict=True)]
        if rows:
            rows.sort(key=lambda r: (r[0] is None, r[0] or ""))
            equal = [[*g] for _, g in groupby(rows, key=lambda r: r[0])]  # of one id in the order of their features
            rows = [r for g in equal for r in (g if len(g) == 1 else sorted(g, key=lambda r: (unpacked(r[1]).astype("<i4").tobytes(), r[2])))]
            idx, val, bias = fit(Packed([r[1] for r in rows]), [r[2] for r in rows])
            yield pa.RecordBatch.from_arrays([pa.array([idx.tobytes()], pa.binary()), pa.array([val.tobytes()], pa.binary()), pa.array([bias])], ["idx", "val", "bias"])

    rows = sample(docs, labels, bound).mapInArrow(hashed, "id string, row binary, toxic int").limit(bound)
    got = rows.repartition(1).mapInArrow(run, "idx binary, val binary, bias double").collect()
    return (np.frombuffer(got[0]["idx"], np.int32), np.frombuffer(got[0]["val"], np.float32), got[0]["bias"]) if got else None


def toxicity_of(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns.

    Texts are scored where they lie; a row is kept or dropped by its own text, so nothing is shuffled.
    """
    docs_names = docs.columns
    return _scored(docs, train(docs, labels), lambda b, out: b.filter(pa.array(out < THRESHOLD)).rename_columns(docs_names), docs.schema)
