"""Hashed text features, vectorised over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T

U32, U64 = np.uint32, np.uint64
_TABLES: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Code point below 2**16 to its lower-case letter, or to a space where it is no letter."""
    if not _TABLES:
        table = np.full(1 << 16, 32, U32)
        for i in [*range(0xD800), *range(0xE000, 1 << 16)]:
            if (c := chr(i)).isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        _TABLES.append(table)
    return _TABLES[0]


def codes(data: np.ndarray, ofs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 rows and the rows' offsets in code points."""
    starts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    text = data.tobytes().decode("utf-8", "surrogatepass")
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), U32), starts[ofs]


def folded(points: np.ndarray) -> np.ndarray:
    """Lower-case letters, and spaces in place of all else, in the whole range of Unicode."""
    table = letters()
    out = table[np.minimum(points, len(table) - 1)]
    high = points >= len(table)
    if high.any():  # a block has few distinct ones
        found, at = np.unique(points[high], return_inverse=True)
        low = [chr(c).lower() if chr(c).isalpha() else " " for c in found.tolist()]
        out[high] = np.array([ord(c) if len(c) == 1 else int(p) for c, p in zip(low, found, strict=True)], U32)[at]
    return out


def grams(points: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Bucket below 2**bits of the n-gram that starts at each position (the last n - 1 wrap; cut them by row)."""
    h = np.full(len(points), n, U64)
    for k in range(n):
        at = points if k == 0 else np.concatenate([points[k:], points[:k]])
        h = (h + at.astype(U64)) * U64(0x9E3779B97F4A7C15)
        h ^= h >> U64(29)
    return (h >> U64(64 - bits)).astype(np.int64)


def row_blocks(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Sub-batches of bounded bytes with the flat bytes and offsets of their text column."""
    for batch in batches:
        data, ofs = T.flat(batch.column(text))
        for lo, hi in T.slices(ofs):
            yield batch.slice(lo, hi - lo), data[ofs[lo] : ofs[hi]], ofs[lo : hi + 1] - ofs[lo]


def agreed(labels: DataFrame, label: str) -> DataFrame:
    """``(doc_id, label)`` once per doc_id; a doc_id whose labels contradict each other teaches nothing."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    both = known.groupBy("doc_id").agg(F.min(label).cast("int").alias(label), F.max(label).cast("int").alias("_most"))
    return both.where(F.col(label) == F.col("_most")).drop("_most")


def bounded_sample(rows: DataFrame, label: str, key: str, bound: int) -> DataFrame:
    """About ``bound`` rows at most, shared evenly by the labels, chosen by a hash of ``key``.

    The choice doesn't depend on partitions or order, so reruns agree; rows without a key are
    drawn by all their columns. The label set is collected; it must be small, as it is for a
    classifier.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    share, left = {}, bound
    for i, (name, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], str(x[0])))):
        share[name] = min(1.0, left / (len(counts) - i) / n)
        left -= min(n, left // (len(counts) - i))
    if not share:
        return rows
    rate = F.lit(0.0)
    for name, part in share.items():
        rate = F.when(F.col(label) == F.lit(name), F.lit(part)).otherwise(rate)
    name = F.coalesce(F.col(key).cast("string"), F.xxhash64(*rows.columns).cast("string"))
    draw = F.pmod(F.xxhash64(name, F.lit("sample")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    return rows.where(draw < rate)


def document_frequency(texts: DataFrame, present, size: int) -> tuple[np.ndarray, int]:
    """Rows with each of ``size`` features, and rows, over the whole table.

    ``present(data, ofs)`` gives an array (rows, size) or a count vector of a block. Each
    task sums its own rows; the sums of all tasks are added by Spark.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(size, np.int64), 0
        for part, data, ofs in row_blocks(batches, 0):
            total += present(data, ofs)
            n += part.num_rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1], at]), pa.int64()), pa.array(np.concatenate([[n], total[at]]), pa.int64())], ["f", "n"])

    rows = texts.mapInArrow(count, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(size, np.int64)
    docs = 0
    for f, n in rows:
        if f < 0:
            docs = n
        else:
            out[f] = n
    return out, docs
