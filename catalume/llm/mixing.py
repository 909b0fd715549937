"""Mixing sources to target weights by pivotal dependent rounding.

Each source takes target / size copies of its documents on average: every document gets the
whole part, and the fractional part is its probability of one more copy. Two documents meet
at a time, or one and all smaller ones together, and words (probability times size) move between
them at random, with the probabilities kept in the mean, until one of them is integral; so the words that a source
takes stay the same at every step. Chunks of a source leave at most one fractional document
each; these residuals meet again, ``fan`` chunks at a time, up a reduction tree, and only the
last one of a source is rounded on its own. A hot source has as many chunks as its rows need.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .session import durable

WEIGHTS = (5.0, 2.0, 1.0)
_EPS = 1e-9


def sizes(docs: DataFrame, key: str | None = None) -> DataFrame:
    """``(doc_id, source, size, row_key, h)`` with the number of words; null texts have none. ``row_key`` is the long column ``key``, or 0, and ``h`` a hash of the text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ofs = T.flat(batch.column(2))
            parts = [T.words(data[ofs[lo] : ofs[hi]], ofs[lo : hi + 1] - ofs[lo])[2] for lo, hi in T.slices(ofs)]
            n = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), batch.column(3), batch.column(4)], ["doc_id", "source", "size", "row_key", "h"])

    row_key = F.lit(0) if key is None else F.col(key)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"), row_key.cast("long").alias("row_key"), F.xxhash64("text").alias("h")).mapInArrow(count, "doc_id long, source string, size long, row_key long, h long")


def targets(totals: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, most: float = 3.0) -> dict[str | None, float]:
    """Share all words by weight; a source never exceeds ``most`` times its size, and its excess goes to the rest."""
    order = sorted(totals, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size = dict(order)
    free, left, out = dict(weight), float(sum(size.values())), {}
    while free:
        whole = sum(free.values())
        over = [s for s, w in free.items() if left * w / whole > most * size[s]]
        if not over:
            out |= {s: left * w / whole for s, w in free.items()}
            break
        for s in over:
            out[s] = most * size[s]
        left -= sum(out[s] for s in over)
        free = {s: w for s, w in free.items() if s not in out}
    return out


def _move(pa: float, za: float, pb: float, zb: float, draw: float) -> tuple[float, float]:
    """Transfer words between two probabilities at random, in the mean nothing, until one of them is 0 or 1."""
    up, down = min((1 - pa) * za, pb * zb), min(pa * za, (1 - pb) * zb)
    words = up if draw * (up + down) < down else -down
    return _snap(pa + words / za), _snap(pb - words / zb)


def _snap(p: float) -> float:
    return 0.0 if p <= _EPS else 1.0 if p >= 1 - _EPS else p


def pivotal(p: np.ndarray, z: np.ndarray, draws: np.ndarray, gap: float = 1.5, share: float = 0.5) -> tuple[np.ndarray, int]:
    """Round the probabilities; the words sum(p * z) stay. Returns them and the index still fractional, or -1.

    Rows come by descending size. Two of like size meet, and the one left open meets the next. Where
    it is ``gap`` times as large as the next, and the smaller ones can take up all it may move
    (``share`` of their words at most), it meets them together instead: their probabilities
    shift alike, towards 0 or towards 1 in proportion, and it is 0 or 1 afterwards. So what is open
    at last is among the smallest, unless a row outweighs what is left. The shift is one linear map for
    all of them, so a chunk takes one pass. ``draws`` has two numbers for each row.
    """
    p = np.array([_snap(x) for x in p])
    live = np.flatnonzero((p > 0) & (p < 1)).tolist()
    words = np.concatenate([np.cumsum(z[live][::-1])[::-1], [0.0]])
    taken = np.concatenate([np.cumsum((p * z)[live][::-1])[::-1], [0.0]])
    by, plus = 1.0, 0.0  # what is still to come has the probability by * p + plus
    held, k, draw = -1, 0, iter(draws)
    while k < len(live):
        i, left = live[k], words[k]
        mean = min(max((by * taken[k] + plus * left) / left, 0.0), 1.0)
        fits = held >= 0 and gap * z[i] <= z[held] <= share * left
        if fits and (1 - p[held]) * z[held] < mean * left and p[held] * z[held] < (1 - mean) * left:
            p[held], shifted = _move(p[held], z[held], mean, left, next(draw))
            c = shifted / mean if shifted <= mean else (1 - shifted) / (1 - mean)
            by, plus = by * c, plus * c if shifted <= mean else 1 - (1 - plus) * c
            held = held if 0 < p[held] < 1 else -1
            continue
        p[i] = _snap(by * p[i] + plus)
        k += 1
        if held >= 0 and 0 < p[i] < 1:
            p[held], p[i] = _move(p[held], z[held], p[i], z[i], next(draw))
        if held < 0 or not 0 < p[held] < 1:
            held = i if 0 < p[i] < 1 else -1
    return p, held


def _draws(key: tuple, n: int) -> np.ndarray:
    return np.random.default_rng(xxhash.xxh64_intdigest(repr(key))).random(n)


def mix(docs: DataFrame, chunk_rows: int = 2000, fan: int = 64, key: str | None = None) -> DataFrame:
    """``(doc_id, source, size, source_size, target, copies, taken)`` of every row.

    Reruns agree: chunks follow a hash of doc_id and text, and all draws follow the chunk. Rows of
    null source form the last source; documents without words take nothing and keep no
    copy; repeated rows are rounded one by one; an empty table gives an empty result. With
    ``key``, a long column of ``docs``, each row brings it along as ``row_key``, and it settles
    the order of rows of one doc_id and text.
    """
    spark = docs.sparkSession
    rows = durable(sizes(docs, key))
    names = ["doc_id", "source", "size", "source_size", "target", "copies", "taken", *(["row_key"] if key else [])]
    stats = [(r["source"], int(r["size"]), r["rows"]) for r in rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).collect()]
    goal = targets([(s, n) for s, n, _ in stats])
    order = sorted(goal, key=lambda s: (s is None, s or ""))
    known = {s: (n, -(-k // chunk_rows)) for s, n, k in stats}
    plan = spark.createDataFrame([(s, i, known[s][0], float(goal[s]), known[s][1]) for i, s in enumerate(order)], "source string, rank int, source_size long, target double, chunks long")
    laid = rows.join(plan.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    laid = laid.withColumn("chunk", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("mix"), "h"), F.col("chunks")))

    def first(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["size", "doc_id", "h", "row_key"], ascending=[False, True, True, True]).reset_index(drop=True)
        z = f["size"].to_numpy(np.float64)
        ratio = f["target"].iloc[0] / max(int(f["source_size"].iloc[0]), 1)
        whole = int(np.floor(ratio + _EPS))
        p = np.where(z > 0, max(ratio - whole, 0.0), 0.0)
        got, held = pivotal(p, z, _draws((*map(int, key), 0), 2 * len(z)))
        f["copies"] = np.where(z > 0, whole + np.floor(got), 0).astype(np.int64)
        f["open"] = np.where(np.arange(len(z)) == held, got, np.nan)
        return f[["doc_id", "source", "rank", "chunk", "size", "source_size", "target", "copies", "open", "row_key"]]

    done = durable(laid.groupBy("rank", "chunk").applyInPandas(first, "doc_id long, source string, rank int, chunk long, size long, source_size long, target double, copies long, open double, row_key long"))
    done = done.withColumn("open", F.when(~F.isnan("open"), F.col("open")))

    def meet(level: int, last: bool):
        def of(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
            f = f.sort_values(["size", "chunk"], ascending=[False, True]).reset_index(drop=True)
            draws = _draws((*map(int, key), level), 2 * len(f) + 1)
            got, held = pivotal(f["p"].to_numpy(), f["size"].to_numpy(np.float64), draws)
            if last and held >= 0:
                got[held], held = float(draws[-1] < got[held]), -1
            f["p"], f["more"] = got, np.where(np.arange(len(f)) == held, -1, got).astype(np.int64)
            f["up"] = int(key[1])
            return f[["rank", "chunk", "up", "size", "p", "more"]]

        return of

    left = done.where("open is not null").select("rank", "chunk", F.col("chunk").alias("up"), "size", F.col("open").alias("p"))
    most, level, settled = max((c for _, c in known.values()), default=0), 1, None
    while most >= 1:
        last = most <= fan
        got = durable(left.withColumn("up", F.floor(F.col("up") / fan).cast("long")).groupBy("rank", "up").applyInPandas(meet(level, last), "rank int, chunk long, up long, size long, p double, more long"))
        fixed = got.where("more >= 0").select("rank", "chunk", "more")
        settled = fixed if settled is None else settled.union(fixed)
        if last:
            break
        left, most, level = got.where("more < 0").select("rank", "chunk", "up", "size", "p"), -(-most // fan), level + 1
    if settled is None:
        return done.withColumn("taken", F.col("copies") * F.col("size")).select(*names)
    settled = settled.withColumn("is_open", F.lit(True))
    out = done.withColumn("is_open", F.col("open").isNotNull()).join(settled, ["rank", "chunk", "is_open"], "left").withColumn("copies", F.col("copies") + F.coalesce("more", F.lit(0)))
    return out.withColumn("taken", F.col("copies") * F.col("size")).select(*names)
