"""Toxicity severity by cumulative-link ordinal regression over sparse text features.

Features are hashed letter 5-grams within words (a space marks the start of a word), taken
as present or absent. Labels give toxic or not; the severity grade of a toxic training text
is the tercile, among toxic texts, of the number of its marks, where a mark is a feature that
toxic training texts hold more often than chance explains. One weight vector is shared by
the ordered thresholds of the cumulative logits: P(grade >= k) = sigmoid(w.x - t_k). The
output is the expected grade. The fit uses at most ``sample`` labelled texts.
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
from .langid import fold

GRADES = 3


@dataclass(frozen=True)
class Params:
    """``evidence``: least likelihood-ratio statistic of a mark, less with few toxic texts (half their number, 12 at least)."""

    bits: int = 20
    sample: int = 10000
    evidence: float = 60.0
    steps: int = 300
    l2: float = 0.02


def _features(data: np.ndarray, ofs: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature of every position (-1 where a 5-gram would cross a word's end or row) and the rows' offsets."""
    points, at = X.codes(data, ofs)
    points = X.folded(points).copy()
    space = points == 32
    f = X.grams(points, 5, bits)
    bad = np.zeros(len(points), bool)
    for k in range(1, 5):
        bad[: len(points) - k] |= space[k:]
        bad[max(0, len(points) - k) :] = True
    for k in range(1, 5):
        edge = at[1:] - k
        bad[edge[(edge >= 0) & (edge < len(points))]] = True
    return np.where(bad, -1, f), at


@dataclass
class Model:
    """Feature ids in ascending order, their weights, and the ordered thresholds."""

    ids: np.ndarray
    w: np.ndarray
    cuts: np.ndarray


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(rows: list[np.ndarray], grade: np.ndarray, size: int, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by full-batch adaptive gradient steps on the cumulative-link likelihood."""
    w, first, gaps = np.zeros(size), 2.0, np.zeros(GRADES - 1)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    m, v = np.zeros(size + GRADES), np.zeros(size + GRADES)
    for step in range(1, p.steps + 1):
        cuts = first + np.concatenate([[0], np.cumsum(np.exp(gaps))])
        s = np.bincount(row, w[col], minlength=len(rows))
        above = _sigmoid(s[:, None] - cuts)  # P(grade >= k), k = 1..GRADES
        wide = np.concatenate([np.ones((len(rows), 1)), above, np.zeros((len(rows), 1))], 1)
        slope = np.concatenate([np.zeros((len(rows), 1)), above * (1 - above), np.zeros((len(rows), 1))], 1)
        i = np.arange(len(rows))
        prob = np.maximum(wide[i, grade] - wide[i, grade + 1], 1e-9)
        d_s = (slope[i, grade] - slope[i, grade + 1]) / prob
        d_cut = np.zeros((len(rows), GRADES + 2))
        d_cut[i, grade] -= slope[i, grade] / prob
        d_cut[i, grade + 1] += slope[i, grade + 1] / prob
        n = max(len(rows), 1)
        g_w = np.bincount(col, d_s[row], minlength=size) / n - p.l2 * w / n
        g_cut = d_cut[:, 1:-1].sum(0) / n
        tails = np.cumsum(g_cut[::-1])[::-1]
        g = np.concatenate([g_w, [tails[0]], tails[1:] * np.exp(gaps)])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, first, gaps = w + move[:size], first + move[size], np.clip(gaps + move[size + 1 :], -4, 4)
    return w, first + np.concatenate([[0], np.cumsum(np.exp(gaps))])


def train(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> Model | None:
    """Fit on ``labels(doc_id, toxic)`` and the texts they name; None without both kinds.

    A doc_id with labels of both kinds teaches nothing.
    """
    chosen = X.bounded_sample(X.agreed(labels, "toxic"), "toxic", "doc_id", p.sample)
    taught = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")
    bits = p.bits

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, ofs in X.row_blocks(batches, 1):
            f, at = _features(data, ofs, bits)
            got = [np.unique(f[at[i] : at[i + 1]]) for i in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([x[x >= 0].astype(np.uint32).tobytes() for x in got], pa.binary())], ["doc_id", "toxic", "x"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        y = np.array([r[1] > 0 for r in got], bool)
        if not y.any() or y.all():
            return
        rows = [np.frombuffer(r[2], np.uint32).astype(np.int64) for r in got]
        with_, without = (np.bincount(np.concatenate([rows[i] for i in np.flatnonzero(k)]), minlength=1 << bits) for k in (y, ~y))
        expected = (with_ + without) * y.mean()
        part = lambda seen, mean: seen * np.log(np.maximum(seen, 1e-9) / np.maximum(mean, 1e-9))
        evidence = 2 * (part(with_, expected) + part(without, with_ + without - expected))
        ids = np.flatnonzero((with_ > expected) & (evidence >= min(p.evidence, max(12.0, y.sum() / 2))))
        rank = np.full(1 << bits, -1)
        rank[ids] = np.arange(len(ids))
        kept = [rank[r][rank[r] >= 0] for r in rows]
        marks = np.array([len(k) for k in kept])
        edges = np.quantile(marks[y], [1 / GRADES, 2 / GRADES])
        grade = np.where(y, 1 + (marks > edges[0]) + (marks > edges[1]), 0)
        w, cuts = fit(kept, grade, len(ids), p)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((ids, w, cuts))], pa.binary())], ["model"])

    got = taught.mapInArrow(sparse, "doc_id long, toxic int, x binary").repartition(1).mapInArrow(learn, "model binary").first()
    return Model(*pickle.loads(got[0])) if got else None


def score(docs: DataFrame, model: Model | None, p: Params = Params()) -> DataFrame:
    """``(doc_id, severity, p_toxic, grade, toxic)`` of each row from its whole text.

    ``severity`` is the expected grade (0 to 3), ``grade`` the likeliest one, ``toxic`` true
    where P(grade >= 1) is at least one half. Null and empty texts score as texts without
    features. Without a model everything is 0 and false. Extra columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    bits = p.bits

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model | None = held.value
        if m is not None:
            rank = np.zeros(1 << bits, np.int32)
            rank[m.ids] = np.arange(1, len(m.ids) + 1)
        for part, data, ofs in X.row_blocks(batches, 1):
            n = part.num_rows
            prob = np.zeros((n, GRADES + 2))
            prob[:, 0] = 1
            if m is not None:
                f, at = _features(data, ofs, bits)
                hit = np.flatnonzero((rank[np.maximum(f, 0)] > 0) & (f >= 0))
                row = np.searchsorted(at, hit, "right") - 1
                pair = np.unique(row * (len(m.ids) + 1) + rank[f[hit]])
                s = np.bincount(pair // (len(m.ids) + 1), m.w[pair % (len(m.ids) + 1) - 1], minlength=n)
                prob[:, 1:-1] = _sigmoid(s[:, None] - m.cuts)
            each = prob[:, :-1] - prob[:, 1:]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prob[:, 1:-1].sum(1)), pa.array(prob[:, 1]), pa.array(each.argmax(1).astype(np.int32)), pa.array(prob[:, 1] >= 0.5)], ["doc_id", "severity", "p_toxic", "grade", "toxic"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(of, "doc_id long, severity double, p_toxic double, grade int, toxic boolean")


def toxicity(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """Learn on all label folds of five but number 0 and score every document."""
    return score(docs, train(docs, labels.where(fold("doc_id", 5) != 0), p), p).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "severity", "p_toxic", "grade", "toxic")
