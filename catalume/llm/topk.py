"""Exact top-k inner-product search with block-at-a-time pruning.

Vectors are integers, their components the terms. Candidates lie in document ranges of
bounded size, cut into blocks; a block keeps the largest and smallest value of every term
and a forward index (its rows). For each query the sum of term maxima times query weights
bounds every score of a block. Blocks are visited in descending order of that bound and
scored through their forward index, until the bound falls below the query's kth score;
blocks whose bound equals it are still scored, so ties come out right.

Queries meet candidates chunk by range: each task holds one range and one chunk of queries,
both of bounded size, and emits k rows a query. No pair of vectors is ever a row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .session import durable


def integers(vectors: DataFrame, column: str = "embedding", scale: int = 256) -> DataFrame:
    """``(vec_id, v)`` with floor(scale * x); vectors null or with null or non-finite components are left out."""
    x = F.transform(column, lambda e: e.cast("double"))
    fine = F.forall(column, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    return vectors.where(F.col("vec_id").isNotNull() & F.col(column).isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * scale)).alias("v"))


def _matrix(v: pd.Series, width: int) -> np.ndarray:
    """Rows padded with zeros to a common width; floats where sums of products stay exact, else integers."""
    out = np.zeros((len(v), width), np.int64)
    for i, row in enumerate(v):
        out[i, : len(row)] = row
    return out


def search_block(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, block: int) -> list[tuple[int, int, int]]:
    """(query, vector, score) of the k best rows of one range for each query; ``ids`` ascend."""
    size = max(int(np.abs(q).max(initial=0)), 1) * max(int(np.abs(rows).max(initial=0)), 1) * max(q.shape[1], 1)
    kind = np.float64 if size < 1 << 53 else np.int64 if size < 1 << 62 else object
    q, rows = q.astype(kind), rows.astype(kind)
    starts = range(0, len(ids), block)
    high = np.stack([rows[s : s + block].max(0) for s in starts])
    low = np.stack([rows[s : s + block].min(0) for s in starts])
    bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    order = np.argsort(-bound, axis=1, kind="stable")
    out = []
    for i in range(len(q_ids)):
        best_s, best_id = np.zeros(0, kind), np.zeros(0, np.int64)
        for b in order[i]:
            if len(best_s) >= k and bound[i, b] < best_s[k - 1]:
                break
            at = slice(b * block, (b + 1) * block)
            own = ids[at] != q_ids[i]
            s = np.concatenate([best_s, (rows[at] @ q[i])[own]])
            d = np.concatenate([best_id, ids[at][own]])
            top = np.lexsort((d, -s))[:k]
            best_s, best_id = s[top], d[top]
        out += [(int(q_ids[i]), int(d), int(s)) for d, s in zip(best_id, best_s, strict=True)]
    return out


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, range_rows: int = 8192, chunk_rows: int = 512, block: int = 64) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best other rows of each row whose vec_id is divisible by ``every``.

    All rows are candidates; only the query's own vec_id is left out. Ties go to the smaller
    vec_id. Vectors of unequal length count missing components as zero. Repeated rows of a
    query's id are one query; a candidate row repeated under one vec_id counts once. Empty
    tables give an empty result.
    """
    rows = durable(integers(vectors).groupBy("vec_id").agg(F.min("v").alias("v")))
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    ranges = max(1, -(-n // range_rows))
    chunks = max(1, -(-queries.count() // chunk_rows))
    laid = durable(rows.repartitionByRange(ranges, "vec_id").withColumn("range", F.spark_partition_id()))
    left = laid.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    right = queries.withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("int")).withColumn("range", F.explode(F.sequence(F.lit(0), F.lit(ranges - 1))))

    def task(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        if len(a) and len(b):
            a = a.sort_values("vec_id")
            out = search_block(b["query_id"].to_numpy(), _matrix(b["q"], width), a["vec_id"].to_numpy(), _matrix(a["v"], width), k, block)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    some = left.groupBy("range", "chunk").cogroup(right.groupBy("range", "chunk")).applyInPandas(task, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return some.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
