"""Language identification by nearest centroid.

A text is a vector of hashed byte n-grams, weighted by TF-IDF and normalised.  Each language has several
centroids, found by spherical k-means over a bounded sample of labelled texts; a text gets the language of
the centroid with the highest cosine.  A text farther from its centroid than nearly all training texts of
that language is marked as rejected: it still names its nearest language, with its low cosine as score.

Edge cases: a null text and a text without a letter get 'und' and 0; so does every text when nothing could
be learned; ties go to the first language in code-point order; texts are read whole; a null id is folded as
the empty text; rows with a null language teach nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, chunks, crc_fold
from .ngrams import letter_grams

DIM = 4096
#: Learning reads at most so many texts of a language (the bound on what one task holds).
SAMPLE_PER_LANG = 600
#: Texts whose vectors are made at once.
CHUNK_ROWS = 1024
CLUSTERS = 4
#: Share of a language's training texts that may be farther than its rejection distance.
REJECT_SHARE = 0.005
FOLDS = 5
_LETTER = regex.compile(r"\p{L}")


@dataclass
class Centroids:
    langs: list[str]
    idf: np.ndarray
    vectors: np.ndarray  # (centroid, DIM)
    owner: np.ndarray  # language of each centroid
    least: np.ndarray  # cosine of each language below which a text is rejected


def counts(texts: list[bytes]) -> np.ndarray:
    """Square roots of the n-gram counts of each text, (text, DIM)."""
    out = np.zeros((len(texts), DIM), np.float32)
    grams, starts = letter_grams(texts, DIM)
    for i in range(len(texts)):
        own = grams[:, starts[i] : starts[i + 1]].ravel()
        out[i] = np.bincount(own[own >= 0], minlength=DIM)
    return np.sqrt(out)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _chunks(texts: list[bytes]):
    """Runs of texts that are bounded in bytes and in number."""
    for first, end in chunks(texts):
        for k in range(first, end, CHUNK_ROWS):
            yield k, min(k + CHUNK_ROWS, end)


def cluster(texts: list[bytes], idf: np.ndarray, clusters: int = CLUSTERS, rounds: int = 8) -> tuple[np.ndarray, float]:
    """A language's centroids by spherical k-means, and the cosine below which a text is rejected."""
    v = _unit(np.concatenate([counts(texts[a:b]) for a, b in _chunks(texts)]) * idf)
    pick = [0]  # farthest-first start: nothing random
    for _ in range(1, min(clusters, len(v))):
        pick.append(int((v @ v[pick].T).max(1).argmin()))
    c = v[pick]
    for _ in range(rounds):
        near = (v @ c.T).argmax(1)
        c = _unit(np.stack([v[near == j].sum(0) if (near == j).any() else c[j] for j in range(len(c))]))
    return c.astype(np.float32), float(np.quantile((v @ c.T).max(1), REJECT_SHARE))


def sample(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG, folds: int = FOLDS) -> DataFrame | None:
    """(lang, text): about ``per_lang`` whole texts of each language from the learning folds, by a hash of the id."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_fold(F.col("doc_id"), folds) != 0))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    draw = (F.xxhash64("doc_id") % 1_000_000 + 1_000_000) % 1_000_000
    keep = F.lit(False)
    for lang, n in sorted(sizes.items()):
        keep = keep | ((F.col("lang") == lang) & (draw < int(1_000_000 * min(1.0, 0.9 * per_lang / n if n > per_lang else 1.0)) + 1))
    return checkpoint(rows.where(keep).select("lang", "text").limit(per_lang * len(sizes)))


def learn(docs: DataFrame) -> Centroids | None:
    """The model of a table.  Texts stay on the executors: the driver gets sums of DIM numbers, and the centroids."""
    rows = sample(docs)
    if rows is None:
        return None

    def seen(batches):
        for b in batches:
            texts = [t.encode() for t in b.column("text").to_pylist() if _LETTER.search(t)]
            n = np.zeros(DIM + 1, np.int64)  # the last one counts the texts
            for first, end in _chunks(texts):
                n[:DIM] += (counts(texts[first:end]) > 0).sum(0)
            n[DIM] = len(texts)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIM + 1), pa.int32()), pa.array(n)], ["gram", "n"])

    total = np.zeros(DIM + 1)
    for r in rows.mapInArrow(seen, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        total[r["gram"]] = r["n"]
    if not total[DIM]:
        return None
    idf = (np.log((1 + total[DIM]) / (1 + total[:DIM])) + 0.1).astype(np.float32)

    def own(table):
        texts = sorted(t.encode() for t in table.column("text").to_pylist())
        if not any(_LETTER.search(t.decode()) for t in texts):
            return pa.table({"lang": pa.array([], pa.string()), "vectors": pa.array([], pa.binary()), "least": pa.array([], pa.float64())})
        c, least = cluster(texts, idf)
        return pa.table({"lang": table.column("lang")[:1].cast(pa.string()), "vectors": pa.array([c.tobytes()], pa.binary()), "least": pa.array([least])})

    found = sorted(rows.groupBy("lang").applyInArrow(own, "lang string, vectors binary, least double").collect(), key=lambda r: r["lang"])
    parts = [np.frombuffer(r["vectors"], np.float32).reshape(-1, DIM) for r in found]
    owner = np.concatenate([np.full(len(p), k) for k, p in enumerate(parts)])
    return Centroids([r["lang"] for r in found], idf, np.concatenate(parts), owner, np.array([r["least"] for r in found], np.float32))


def identify(docs: DataFrame, model: Centroids | None, folds: int = FOLDS) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            texts = b.column("text").to_pylist()
            lang, score, far = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
            has = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if m else []
            own = [texts[i].encode() for i in has]
            for first, end in _chunks(own):
                cos = _unit(counts(own[first:end]) * m.idf) @ m.vectors.T
                best = cos.argmax(1)
                for j, i in enumerate(has[first:end]):
                    k = m.owner[best[j]]
                    lang[i], score[i], far[i] = m.langs[k], min(1.0, max(0.0, float(cos[j, best[j]]))), cos[j, best[j]] < m.least[k]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(lang, pa.string()), pa.array(score), pa.array(far)], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = docs.select("doc_id", (crc_fold(F.col("doc_id"), folds) == 0).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double, rejected boolean")


def language_of(docs: DataFrame) -> DataFrame:
    return identify(docs, learn(docs))
