"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed 1- to 3-grams of lower-cased letters (anything else counts as a space).
Document frequencies cover every training document. The weights are fitted by
follow-the-regularised-leader (per-coordinate rates, elastic-net penalties: L1 keeps most
weights at zero) on a sample of at most ``sample`` labelled rows, spread over the
languages; a fifth of it is kept aside to fit the temperature that calibrates the scores.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import features as X

UNKNOWN = "und"


@dataclass(frozen=True)
class Params:
    bits: int = 14
    sample: int = 8000
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1


def _counts(data: np.ndarray, ofs: np.ndarray, bits: int) -> Iterator[np.ndarray | None]:
    """Feature counts of each row; None where it has no letter."""
    points, at = X.codes(data, ofs)
    points = X.folded(points)
    seen = np.concatenate([[0], np.cumsum(points != 32)])
    all_grams = [X.grams(points, n, bits) for n in (1, 2, 3)]
    for i in range(len(at) - 1):
        lo, hi = at[i], at[i + 1]
        if seen[hi] == seen[lo]:
            yield None
        else:
            yield np.bincount(np.concatenate([g[lo : max(lo, hi - n)] for n, g in enumerate(all_grams)]), minlength=1 << bits)


def _present(bits: int):
    def of(data: np.ndarray, ofs: np.ndarray) -> np.ndarray:
        total = np.zeros(1 << bits, np.int64)
        for c in _counts(data, ofs, bits):
            if c is not None:
                total += c > 0
        return total

    return of


def _vector(count: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(count)
    value = (1 + np.log(count[at])) * idf[at]
    return at, value / max(np.sqrt((value * value).sum()), 1e-12)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, p: Params) -> tuple[np.ndarray, float]:
    """Weights (features, classes) and temperature from sparse rows."""
    z, n = np.zeros((1 << p.bits, classes)), np.zeros((1 << p.bits, classes))

    def weights(at: np.ndarray | slice) -> np.ndarray:
        zz = z[at]
        return np.where(np.abs(zz) <= p.l1, 0, -(zz - np.sign(zz) * p.l1) / ((p.beta + np.sqrt(n[at])) / p.alpha + p.l2))

    order = np.random.default_rng(7).permutation(len(rows))
    kept = order[: len(order) // 5] if len(order) >= 50 else order[:0]
    train = order[len(kept) :]
    for _ in range(p.epochs):
        for i in train:
            at, x = rows[i]
            w = weights(at)
            prob = softmax(x @ w)
            prob[y[i]] -= 1
            g = x[:, None] * prob
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / p.alpha
            z[at] += g - step * w
            n[at] += g * g
    w = weights(slice(None))
    if not len(kept):
        return w, 1.0
    logits = np.stack([rows[i][1] @ w[rows[i][0]] for i in kept])
    truth = y[kept]
    lo, hi = np.log(0.05), np.log(20.0)  # golden section over the log of the temperature

    def loss(t: float) -> float:
        return -np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(truth)), truth], 1e-12)).mean()

    for _ in range(40):
        a, b = hi - (hi - lo) * 0.618, lo + (hi - lo) * 0.618
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return w, float(np.exp((lo + hi) / 2))


@dataclass
class Model:
    names: list[str]
    idf: np.ndarray
    w: np.ndarray
    temperature: float


def train(docs: DataFrame, p: Params = Params()) -> Model:
    """Fit on ``docs(doc_id, text, lang)``; rows without text or language teach nothing."""
    docs = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    df, total = X.document_frequency(docs.select("text"), _present(p.bits), 1 << p.bits)
    idf = np.log((1 + total) / (1 + df)) + 1
    names = sorted(r[0] for r in docs.select("lang").distinct().collect())
    bits = p.bits

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, ofs in X.row_blocks(batches, 1):
            ids, idx, val, lang = [], [], [], part.column(2).to_pylist()
            for i, c in enumerate(_counts(data, ofs, bits)):
                at, value = _vector(c, idf) if c is not None else (np.zeros(0, np.int64), np.zeros(0))
                ids.append(part.column(0)[i].as_py())
                idx.append(at.astype(np.uint16 if bits <= 16 else np.uint32).tobytes())
                val.append(value.astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(idx, pa.binary()), pa.array(val, pa.binary()), pa.array(lang, pa.string())], ["doc_id", "idx", "val", "lang"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["doc_id"] is None, r["doc_id"], r["lang"], r["idx"]))
        rows = [(np.frombuffer(r["idx"], np.uint16 if bits <= 16 else np.uint32).astype(np.int64), np.frombuffer(r["val"], np.float32).astype(np.float64)) for r in got]
        w, t = fit(rows, np.array([names.index(r["lang"]) for r in got], np.int64), len(names), p)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((w.astype(np.float32), t))], pa.binary())], ["model"])

    if not names:
        return Model([], idf, np.zeros((1 << p.bits, 0), np.float32), 1.0)
    sample = X.bounded_sample(docs, "lang", "doc_id", p.sample).mapInArrow(sparse, "doc_id long, idx binary, val binary, lang string")
    w, t = pickle.loads(sample.repartition(1).mapInArrow(learn, "model binary").first()[0])
    return Model(names, idf, w, t)


def _predictions(data: np.ndarray, ofs: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """Class index (the number of classes: unknown) and score of each row."""
    bits, n = int(np.log2(len(m.idf))), len(ofs) - 1
    best, score = np.full(n, len(m.names)), np.ones(n)
    for i, c in enumerate(_counts(data, ofs, bits)):
        if c is not None and m.names:
            at, value = _vector(c, m.idf)
            prob = softmax(value @ m.w[at] / m.temperature)
            best[i], score[i] = prob.argmax(), prob.max()
        elif c is not None:
            score[i] = 0
    return best, np.clip(score, 0, 1)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, lang_pred, score)`` of each row, from its whole text alone.

    Null texts and texts without letters get ``und`` with score 1.0; so does every row,
    with score 0.0, if nothing could be learned. Extra columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*held.value.names, UNKNOWN], object)
        for part, data, ofs in X.row_blocks(batches, 1):
            best, score = _predictions(data, ofs, held.value)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names[best], pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(of, "doc_id long, lang_pred string, score double")


def accept(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is known with a score of at least ``least``.

    Rows with null or letterless text are rejected. Nothing is shuffled.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, ofs in X.row_blocks(batches, at):
            best, score = _predictions(data, ofs, held.value)
            yield part.filter(pa.array((best < len(held.value.names)) & (score >= least)))

    return docs.mapInArrow(of, docs.schema)


def fold(key: str, parts: int) -> F.Column:
    """crc32 of the key as text, modulo ``parts``; null keys fall in fold -1."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(parts)), F.lit(-1))


def language_id(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """Train on all folds of four but number 2 and predict every row: ``(doc_id, held_out, lang_pred, score)``."""
    model = train(docs.where(fold("doc_id", 4) != 2), p)
    return predict(docs, model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
