"""Document fingerprints: a quartile bucket digest of hashed byte triplets.

Triplets drawn from a sliding window of five bytes (the adjacent one and two with gaps) are
hashed into 128 buckets. Two bits per bucket tell which quartile of the bucket counts it
falls in; a logarithmic length and the ratios of the quartiles lead. Digests are compared
by a difference score that is bounded, which gives a likeness from 0 to 1.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T

BUCKETS = 128
#: Largest difference that still counts; beyond it the likeness is 0.
BOUND = 200.0


def digest(data: np.ndarray) -> bytes:
    """34 bytes: log length, quartile ratios, 32 bytes of bucket quartiles."""
    n = len(data)
    x = data.astype(np.uint32)
    count = np.zeros(BUCKETS, np.int64)
    for k, (i, j) in enumerate(((1, 2), (1, 3), (2, 4))):
        if n > j:
            m = n - j
            h = ((x[:m] * np.uint32(0x9E3779B1)) ^ (x[i : i + m] * np.uint32(0x85EBCA77)) ^ (x[j : j + m] * np.uint32(0xC2B2AE3D))) + np.uint32(k * 0x27D4EB2F)
            count += np.bincount((h * np.uint32(0x2C1B3C6D)) >> np.uint32(25), minlength=BUCKETS)
    q1, q2, q3 = np.sort(count)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    grade = (count > q1).astype(np.uint8) + (count > q2) + (count > q3)
    packed = (grade[0::4] << 6) | (grade[1::4] << 4) | (grade[2::4] << 2) | grade[3::4]
    length = min(255, round(16 * np.log2(n + 1)))
    ratios = (int(15 * q1 / q3) << 4 | int(15 * q2 / q3)) if q3 else 0
    return bytes([length, ratios]) + packed.astype(np.uint8).tobytes()


_GRADES = np.array([[(b >> s) & 3 for s in (6, 4, 2, 0)] for b in range(256)], np.int16)


def difference(a: bytes, b: bytes) -> float:
    """Sum of bucket differences (quartiles 1, 2 or 3 apart cost 1, 2 or 6), length and ratios."""
    x, y = _GRADES[np.frombuffer(a, np.uint8)[2:]], _GRADES[np.frombuffer(b, np.uint8)[2:]]
    apart = np.abs(x - y)
    body = float(apart.sum() + 3 * (apart == 3).sum())
    length = abs(a[0] - b[0])
    ratio = abs((a[1] >> 4) - (b[1] >> 4)) + abs((a[1] & 15) - (b[1] & 15))
    return body + (length if length <= 8 else 2 * length - 8) + ratio


def likeness(a: bytes, b: bytes) -> float:
    return max(0.0, 1.0 - difference(a, b) / BOUND)


def _points(data: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


def _cut(data: bytes, n: int) -> int:
    """Byte offset of code point ``n``."""
    at = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    return int(at[n]) if n < len(at) else len(data)


def edited(text: bytes, following: bytes) -> bytes:
    """The last quarter (rounded down) of the code points replaced by the first as many of the next text."""
    n = _points(text)
    k = n // 4
    return text[: _cut(text, n - k)] + following[: _cut(following, k)]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _row(doc_id: int | None, text: bytes, following: bytes, prints: dict[bytes, bytes] | None = None) -> tuple:
    new = edited(text, following)
    a, b, c = (digest(np.frombuffer(x, np.uint8)) for x in (text, new, following))
    return doc_id, _points(text), hashlib.sha256(new).hexdigest(), a.hex(), b.hex(), likeness(a, b), likeness(a, c)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """Rows as they are: ids stay whole numbers beside nulls."""
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fingerprint)`` alone, without any shuffle; null texts count as empty."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ofs = T.flat(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([digest(data[ofs[i] : ofs[i + 1]]).hex() for i in range(batch.num_rows)], pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(of, "doc_id long, fingerprint string")


def with_neighbours(docs: DataFrame, rows_per_part: int = 20000, part_bytes: int = 32 << 20) -> DataFrame:
    """Fingerprints of every document and of its text edited with the next document's start.

    Documents follow each other by ascending doc_id (nulls first, ties by text), the last
    one is followed by the first. The table is range-partitioned and sorted, so each task
    sees neighbours in order; only the first and last row of each partition meet again in a
    second, small step. Null texts count as empty; a single document follows itself; an
    empty table gives an empty result; extra columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    n, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(1, -(-n // rows_per_part), -(-size // part_bytes), docs.sparkSession.sparkContext.defaultParallelism)
    laid = docs.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text").withColumn("part", F.spark_partition_id())

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, part, first = None, 0, None
        for batch in batches:
            ids, (data, ofs) = batch.column(0).to_pylist(), T.flat(batch.column(1))
            out, marks = [], []
            for i, doc_id in enumerate(ids):
                here = (doc_id, data[ofs[i] : ofs[i + 1]].tobytes())
                if first is None:
                    first, part = here, batch.column(2)[0].as_py()
                else:
                    out.append(_row(*last, here[1]))
                last = here
            yield _batch(out, marks)
        if first is not None:
            yield _batch([], [(part, 0, *first), (part, 1, *last)])

    def _batch(out: list[tuple], marks: list[tuple]) -> pa.RecordBatch:
        return _rows([(*r, None, None, None) for r in out] + [(m[2], *[None] * 6, m[0], m[1], m[3]) for m in marks], _SCHEMA)

    from .session import durable

    both = durable(laid.mapInArrow(pairs, _OUT + ", part int, mark int, text binary"))
    ends = both.where("mark is not null").select("part", "mark", "doc_id", "text")
    # the nth filled partition's last row is followed by the first row of the (n + 1)th, cyclically
    filled = sorted(r[0] for r in ends.where("mark = 0").select("part").collect())
    after = docs.sparkSession.createDataFrame([(p, filled[(i + 1) % len(filled)]) for i, p in enumerate(filled)], "part int, next_part int")
    lasts = ends.where("mark = 1").select("part", "doc_id", "text").join(after, "part")
    firsts = ends.where("mark = 0").select(F.col("part").alias("next_part"), F.col("text").alias("following"))

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_row(*r) for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield _rows(rows, pa.schema(list(_SCHEMA)[:7]))

    closing = lasts.join(firsts, "next_part").select("doc_id", "text", "following").mapInArrow(rest, _OUT)
    return both.where("mark is null").select(*_COLS[:7]).union(closing)


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("part", pa.int32()), ("mark", pa.int32()), ("text", pa.binary())])
_COLS = list(_SCHEMA.names)
