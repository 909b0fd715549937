"""Token ids as ORC files: run-length coded integers in stripes, with row indexes and Bloom filters on document ids.

Documents are laid in ascending doc_id order over files of about equal size, one file a
range; a file's rows carry their place (``part``, and ``at``, the ids before them in their
file), so readers get global positions from one small number per file. ORC keeps integer
lists run-length coded, cuts files into stripes that are read in parallel, and its
indexes and Bloom filters let a reader skip stripes and row groups that can't hold a
document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as T
from . import tokens as K

#: Bytes of text that are encoded at once, and words that a worker remembers.
BLOCK, KEEP = 3 << 20, 300_000
#: Columns of the files.
FILES = "part int, doc_id long, at long, n_ids long, ids array<int>"


@dataclass(frozen=True)
class Layout:
    """Text bytes of a file, bytes of a stripe, rows of an index group, and the false positives of the Bloom filters."""

    part_bytes: int = 32 << 20
    stripe_bytes: int = 16 << 20
    group_rows: int = 2000
    fpp: float = 0.01

    def options(self) -> dict[str, str]:
        return {
            "compression": "zstd",
            "orc.stripe.size": str(self.stripe_bytes),
            "orc.create.index": "true",
            "orc.row.index.stride": str(self.group_rows),
            "orc.bloom.filter.columns": "doc_id",
            "orc.bloom.filter.fpp": str(self.fpp),
        }


def _encoded(batches: Iterable[pa.RecordBatch], tokenizer: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """Rows of a file, in the order of a sorted partition."""
    at = 0
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    encoder = K.loaded(K.ByteBpe, tokenizer, False, KEEP)
    for batch in K.blocks(batches, 1, BLOCK):
        data, ofs = T.flat(batch.column(1))
        ids, ends, _ = encoder.encode(data, ofs)
        rows = batch.num_rows
        flat = np.full(len(ids) + rows, end_id, np.int32)
        flat[np.arange(len(ids)) + np.repeat(np.arange(rows), np.diff(ends))] = ids
        ends = ends + np.arange(rows + 1)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(rows, part, np.int32)),
                batch.column(0),
                pa.array(at + ends[:-1]),
                pa.array(np.diff(ends)),
                pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat)),
            ],
            ["part", "doc_id", "at", "n_ids", "ids"],
        )
        at += int(ends[-1])
    pa.default_memory_pool().release_unused()


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, layout: Layout | None = None) -> None:
    """Token ids of every whole text, ``end_id`` after each, as ORC files in ``path``.

    Null texts count as empty: they have the end id alone. Rows go by ascending doc_id, null
    ids first; rows of one id by a hash of their text, then by text, so a reused id is spread
    over files and reruns agree. Repeated rows are written as often as they occur, extra
    columns are ignored, and an empty table gives files without rows. A text's ids are one list, so a
    text may have 2**31 ids at most.
    """
    layout = layout or Layout()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-size // layout.part_bytes))
    laid = docs.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "h").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h", "text")
    rows = laid.select("doc_id", "text").mapInArrow(lambda b: _encoded(b, tokenizer, end_id), FILES)
    rows.write.options(**layout.options()).orc(path)


def files(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the files as they are; filters on ``doc_id`` reach row indexes and Bloom filters."""
    return spark.read.schema(FILES).orc(path)


def starts(spark: SparkSession, path: str) -> DataFrame:
    """``(part, before)``: ids in all files before each file; one row for each ``part_bytes`` of text."""
    sizes = files(spark, path).groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    before = np.concatenate([[0], np.cumsum([r["n"] for r in sizes])]).astype(int).tolist()
    return spark.createDataFrame([(r["part"], b) for r, b in zip(sizes, before[:-1], strict=True)], "part int, before long")


def read(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, ids)`` in the files' own order of stripes; ``start`` counts the ids of all documents before."""
    placed = files(spark, path).join(F.broadcast(starts(spark, path)), "part")
    return placed.select("doc_id", (F.col("before") + F.col("at")).alias("start"), "ids")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Rows of :func:`read` of some documents; stripes and row groups without them are skipped."""
    return read(spark, path).where(F.col("doc_id").isin(doc_ids))


def summary(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` from the files: the checksum of each document's ids as little-endian 32-bit integers."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(2)
            ends = ids.offsets.to_numpy()
            raw = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False))).cast("B")
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(ends).astype(np.int64)), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return read(spark, path).mapInArrow(of, "doc_id long, start long, n_tokens long, ids_crc32 long")
