"""Quality classifier: nearest-neighbour voting in a latent semantic space.

Every text becomes a TF-IDF vector of hashed byte trigrams beside hashed word shapes and
repetition marks; document frequencies cover the whole table. A truncated singular value
decomposition of at most ``sample`` labelled texts gives the latent space, and the vectors
of those texts are broadcast (``sample`` x ``rank`` floats, a fixed bound). Each document's
cosine products with all of them are computed exactly, a block at a time, and the labels of
its ``neighbours`` nearest are averaged with their similarities as weights.
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
from . import textops as T
from .langid import fold

U64 = np.uint64


@dataclass(frozen=True)
class Params:
    trigram_bits: int = 11
    shape_bits: int = 10
    sample: int = 4000
    rank: int = 48
    neighbours: int = 15

    @property
    def size(self) -> int:
        return (1 << self.trigram_bits) + (1 << self.shape_bits)


def _word_marks(data: np.ndarray, ofs: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Shape bucket of each word of all rows, then marks of repetition; and the row of each."""
    start, end, n = T.words(data, ofs)
    row = np.repeat(np.arange(len(n)), n)
    if not len(start):
        return np.zeros(0, np.int64), row
    upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
    other = ~(upper | lower | (data >= 128) | T.is_space(data))
    total = lambda m: np.diff(np.concatenate([[0], np.cumsum(m)])[np.stack([start, end])], axis=0)[0]
    size, up, odd = end - start, total(upper), total(other)
    tail = np.where(other[end - 1], data[end - 1], 0)
    shape = (np.minimum(size, 12) * 8 + np.minimum(up, 3) * 2 + (up == size)).astype(U64) * U64(1024) + np.minimum(odd, 3).astype(U64) * U64(256) + tail.astype(U64)
    h = T.range_hash(T.prefix_hash(data), start, end)
    again = np.zeros(len(h), bool)
    for back in (1, 2):
        again[back:] |= (h[back:] == h[:-back]) & (row[back:] == row[:-back])
    bucket = (T.mix(shape) >> U64(64 - bits)).astype(np.int64)
    marks = (T.mix(again.astype(U64) + U64(77)) >> U64(64 - bits)).astype(np.int64)
    # share of words that stand for the first time in their row, as one of eight marks repeated once per word
    _, first = np.unique(h + row.astype(U64) * U64(0x9E3779B97F4A7C15), return_index=True)
    fresh = np.bincount(row[first], minlength=len(n)) / np.maximum(n, 1)
    level = (T.mix(np.minimum(fresh * 8, 7).astype(U64) + U64(991)) >> U64(64 - bits)).astype(np.int64)
    return np.concatenate([bucket, marks, level[row]]), np.concatenate([row, row, row])


def _counts(data: np.ndarray, ofs: np.ndarray, p: Params) -> np.ndarray:
    """Feature counts (rows, size)."""
    rows, left = len(ofs) - 1, 1 << p.trigram_bits
    out = np.zeros((rows, p.size), np.float32)
    tri = X.grams(data.astype(np.uint32), 3, p.trigram_bits)
    for i in range(rows):
        out[i, :left] = np.bincount(tri[ofs[i] : max(ofs[i], ofs[i + 1] - 2)], minlength=left)
    marks, row = _word_marks(data, ofs, p.shape_bits)
    out[:, left:] = np.bincount(row * (1 << p.shape_bits) + marks, minlength=rows << p.shape_bits).reshape(rows, -1)
    return out


def _vectors(count: np.ndarray, idf: np.ndarray, p: Params) -> np.ndarray:
    """TF-IDF rows; trigrams (dampened) and marks (in proportion) weigh the same."""
    left = 1 << p.trigram_bits
    out = np.empty_like(count)
    out[:, :left] = np.log1p(count[:, :left]) * idf[:left]
    out[:, left:] = np.sqrt(count[:, left:]) * idf[left:]
    for part in (out[:, :left], out[:, left:]):
        part /= np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-9)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _blocks(ofs: np.ndarray, limit: int = 256) -> Iterator[tuple[int, int]]:
    for lo in range(0, len(ofs) - 1, limit):
        yield lo, min(lo + limit, len(ofs) - 1)


@dataclass
class Model:
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray


def svd(x: np.ndarray, rank: int) -> np.ndarray:
    """Leading right singular vectors (columns) by subspace iteration with a fixed start."""
    q = np.random.default_rng(5).standard_normal((x.shape[1], min(rank + 8, *x.shape))).astype(np.float32)
    for _ in range(6):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ v.T)[:, :rank].astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> Model | None:
    """Fit on ``labels(doc_id, label)`` and the texts they name; corpus statistics cover all ``docs``.

    A doc_id with labels of both kinds teaches nothing.
    """

    def present(data: np.ndarray, ofs: np.ndarray) -> np.ndarray:
        return sum((np.count_nonzero(_counts(data[ofs[a] : ofs[b]], ofs[a : b + 1] - ofs[a], p), axis=0) for a, b in _blocks(ofs)), np.zeros(p.size, np.int64))

    labels = X.agreed(labels, "label")
    total = labels.count()
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("quality")), F.lit(1_000_003))
    chosen = labels.where(draw < p.sample / max(total, p.sample) * 1_000_003)  # at most about ``sample`` rows
    taught = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")
    df, n = X.document_frequency(docs.select("text"), present, p.size)
    idf = (np.log((1 + n) / (1 + df)) + 0.1).astype(np.float32)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, ofs in X.row_blocks(batches, 1):
            for a, b in _blocks(ofs):
                x = _vectors(_counts(data[ofs[a] : ofs[b]], ofs[a : b + 1] - ofs[a], p), idf, p).astype(np.float16)
                yield pa.RecordBatch.from_arrays([part.column(0).slice(a, b - a), part.column(2).slice(a, b - a), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "label", "x"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((i, y, x) for b in batches for i, y, x in zip(*(c.to_pylist() for c in b.columns), strict=True))
        if not got:
            return
        x = np.frombuffer(b"".join(r[2] for r in got), np.float16).reshape(len(got), -1).astype(np.float32)
        basis = svd(x, p.rank)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((basis, _unit(x @ basis), np.array([r[1] for r in got], np.float32)))], pa.binary())], ["model"])

    got = taught.mapInArrow(vectors, "doc_id long, label int, x binary").repartition(1).mapInArrow(learn, "model binary").first()
    return Model(idf, *pickle.loads(got[0])) if got else None


def vote(x: np.ndarray, m: Model, k: int) -> np.ndarray:
    """Weighted share of label 1 among the k nearest vectors of each row; labelled vectors come in order of doc_id."""
    best = np.zeros((len(x), 0), np.int64)  # distance in 1e-5, then place: no two are equal
    for lo in range(0, len(m.labels), 1024):
        cos = np.rint((x @ m.vectors[lo : lo + 1024].T).astype(np.float64) * 1e5).astype(np.int64)
        best = np.concatenate([best, (200_000 - cos) << 24 | np.arange(lo, lo + cos.shape[1])], 1)
        if best.shape[1] > k:
            best = np.partition(best, k - 1, axis=1)[:, :k]
    best = np.sort(best, axis=1)  # so sums don't depend on blocks
    near, label = (200_000 - (best >> 24)) / 1e5, m.labels[best & (1 << 24) - 1]
    weight = np.maximum(near, 0.0) ** 4 + 1e-6
    return (weight * label).sum(1) / weight.sum(1)


def score(docs: DataFrame, model: Model | None, p: Params = Params()) -> DataFrame:
    """``(doc_id, score)``: the similarity-weighted share of label 1 among the nearest labelled texts.

    A neighbour's vote weighs the fourth power of its cosine. Null texts count as empty. Without
    any labelled text every score is 0.5. Extra columns are ignored; equal texts get equal
    scores; ties between neighbours (cosines to five places) go to the smaller doc_id.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model | None = held.value
        for part, data, ofs in X.row_blocks(batches, 1):
            for a, b in _blocks(ofs):
                out = np.full(b - a, 0.5)
                if m is not None:
                    x = _unit(_vectors(_counts(data[ofs[a] : ofs[b]], ofs[a : b + 1] - ofs[a], p), m.idf, p) @ m.basis)
                    k = min(p.neighbours, len(m.labels))
                    out = vote(x, m, k)
                yield pa.RecordBatch.from_arrays([part.column(0).slice(a, b - a), pa.array(np.clip(out, 0, 1))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(of, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """Learn ``labels.quality`` on all folds of five but number 0 and score every document."""
    known = labels.where(fold("doc_id", 5) != 0).select("doc_id", F.col("quality").alias("label"))
    out = score(docs, train(docs, known, p), p)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
