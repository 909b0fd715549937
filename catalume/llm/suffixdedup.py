"""Suffix-array dedup: remove every byte that a string of ``length`` bytes standing elsewhere covers.

1. Every window of ``length`` bytes picks the smallest hash among its ``gram``-byte grams
   (leftmost if tied): its anchor. Equal windows pick equal anchors at equal offsets, so
   anchors that occur once in the corpus rule their windows out, and the rest compare with
   windows of the same anchor only. Consecutive windows of one anchor form a run, whose
   bytes are its context.
2. Contexts that occur more than once need no comparison: all their windows repeat.
   Anchors with several contexts, one of them single, stay open.
3. The distinct open contexts are dealt by anchor into buckets of bounded bytes. In each,
   shard Burrows-Wheeler transforms are merged by interleave refinement (see ``bwt``), and
   its repeated intervals tell which windows repeat.
4. Anchors with too many distinct contexts for one bucket have each window of these contexts
   counted by a 128-bit hash instead, which Spark combines before the shuffle.

Only ids, offsets and hashes of candidates are shuffled, besides the texts themselves, once
to cut open contexts and once to remove the spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bwt
from . import textops as T
from .session import durable

U64 = np.uint64


@dataclass(frozen=True)
class Params:
    """``bucket_bytes``: text merged in one task; ``kinds``: most distinct contexts of an anchor dealt to one bucket."""

    length: int = 200
    gram: int = 50
    bucket_bytes: int = 1_500_000
    kinds: int = 4096
    slice_bytes: int = 1 << 20


def runs_of(data: np.ndarray, ofs: np.ndarray, p: Params) -> tuple[np.ndarray, ...]:
    """Row, first and last window start, anchor hash and context hash of each run of a block of rows."""
    count = np.maximum(np.diff(ofs) - p.length + 1, 0)
    total = int(count.sum())
    if not total:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(U64), none.astype(U64)
    sums = T.prefix_hash(data)
    _, down = T.powers(len(sums))
    at = len(data) - p.gram + 1
    gram = T.mix((sums[p.gram :] - sums[:at]) * down[:at] + U64(p.gram))
    bits = U64(max(1, int(len(data)).bit_length()))
    low = (U64(1) << bits) - U64(1)
    best = (gram & ~low) | np.arange(at, dtype=U64)
    width, have = p.length - p.gram + 1, 1
    while 2 * have <= width:
        best = np.minimum(best[: len(best) - have], best[have:])
        have *= 2
    if have < width:
        best = np.minimum(best[: len(best) - (width - have)], best[width - have :])
    start = np.repeat(ofs[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(total)
    anchor = (best[start] & low).astype(np.int64)
    edge = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
    first, last = start[np.concatenate([[0], edge])], start[np.concatenate([edge - 1, [total - 1]])]
    row = np.searchsorted(ofs, first, "right") - 1
    return row, first - ofs[row], last - ofs[row], gram[anchor[np.concatenate([[0], edge])]], T.range_hash(sums, first, last + p.length)


def _pieces(ofs: np.ndarray, p: Params) -> Iterator[tuple[int, int, int, int, int]]:
    """(first row, end row, first byte, end byte, shift): blocks of rows, and overlapping pieces of longer rows."""
    for lo, hi in T.slices(ofs, p.slice_bytes):
        if hi - lo == 1 and ofs[hi] - ofs[lo] > 2 * p.slice_bytes:
            for a in range(ofs[lo], ofs[hi] - p.length + 1, p.slice_bytes):
                yield lo, hi, a, min(a + p.slice_bytes + p.length - 1, ofs[hi]), int(a - ofs[lo])
        else:
            yield lo, hi, int(ofs[lo]), int(ofs[hi]), 0


def _runs(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, (data, ofs) = batch.column(0).to_numpy(zero_copy_only=False), T.flat(batch.column(1))
        for lo, hi, a, b, shift in _pieces(ofs, p):
            local = ofs[lo : hi + 1] - a if not shift and b == ofs[hi] else np.array([0, b - a])
            row, first, last, ah, ch = runs_of(data[a:b], local, p)
            yield pa.RecordBatch.from_arrays([pa.array(keys[lo:hi][row]), pa.array((first + shift).astype(np.int32)), pa.array((last + shift).astype(np.int32)), pa.array(ah.view(np.int64)), pa.array(ch.view(np.int64))], ["key", "lo", "hi", "ah", "ch"])


def _windows(s: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each window."""
    data = np.frombuffer(s, np.uint8)
    sums, twice = T.prefix_hash(data), T.prefix_hash(data[::-1].copy())
    at = np.arange(len(data) - length + 1)
    back = len(data) - at - length
    return T.range_hash(sums, at, at + length).view(np.int64), T.range_hash(twice, back, back + length).view(np.int64)


def _spans(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal covered byte ranges of sorted window starts."""
    if not len(starts):
        return starts, starts
    gap = np.flatnonzero(np.diff(starts) > length) + 1
    return starts[np.concatenate([[0], gap])], starts[np.concatenate([gap - 1, [len(starts) - 1]])] + length


def covered(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """Byte ranges ``(key, a, b)`` of ``docs(key, text)`` that repeated windows cover; ranges may overlap."""
    runs = docs.mapInArrow(lambda b: _runs(b, p), "key long, lo int, hi int, ah long, ch long")
    again = runs.groupBy("ah").agg(F.count("*").alias("n")).where("n > 1").select("ah")
    some = durable(runs.join(again, "ah"))
    contexts = some.groupBy("ah", "ch").agg(F.count("*").alias("n"), F.min(F.struct("key", "lo", "hi")).alias("at"))
    contexts = durable(contexts.select("ah", "ch", "n", "at.key", "at.lo", "at.hi"))
    anchors = contexts.groupBy("ah").agg(F.count("*").alias("kinds"), F.count_if(F.col("n") == 1).alias("lone")).where("kinds > 1 and lone > 0")
    whole = some.join(contexts.where("n > 1").select("ah", "ch"), ["ah", "ch"]).select("key", F.col("lo").alias("a"), (F.col("hi") + p.length).alias("b"))

    wanted = contexts.join(anchors, "ah").groupBy("key").agg(F.collect_list(F.struct("lo", "hi", "ah", "ch", "n", "kinds")).alias("want"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ofs = T.flat(batch.column(1))
            out = [(key, w["lo"], w["ah"], w["ch"], w["n"], w["kinds"], data[ofs[i] + w["lo"] : ofs[i] + w["hi"] + p.length].tobytes()) for i, (key, want) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)) for w in want]
            yield pa.RecordBatch.from_pylist([dict(zip(_STRINGS.names, r, strict=True)) for r in out], _STRINGS)

    one = docs.join(wanted, "key").select("key", "text", "want")
    strings = durable(one.mapInArrow(cut, "key long, lo int, ah long, ch long, n long, kinds long, s binary").dropDuplicates(["ah", "ch"]))
    usual, hot = strings.where(F.col("kinds") <= p.kinds), strings.where(F.col("kinds") > p.kinds)
    size = usual.agg(F.coalesce(F.sum(F.octet_length("s")), F.lit(0))).first()[0]
    buckets = max(1, -(-size // p.bucket_bytes))

    def merge(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["ah", "ch"])
        rows = []
        for key, lo, n, starts in zip(f["key"], f["lo"], f["n"], bwt.repeated_starts(list(f["s"]), p.length), strict=True):
            if n == 1:
                rows += [(key, lo + a, lo + b) for a, b in zip(*_spans(starts, p.length), strict=True)]
        return pd.DataFrame(rows, columns=["key", "a", "b"])

    merged = usual.groupBy(F.pmod("ah", F.lit(buckets)).alias("bucket")).applyInPandas(merge, "key long, a int, b int")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, lo, n, s in zip(*(batch.column(c).to_pylist() for c in ("key", "lo", "n", "s")), strict=True):
                x, y = _windows(s, p.length)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(x), pa.int64()), pa.array(np.arange(lo, lo + len(x), dtype=np.int32)), pa.array([n] * len(x), pa.int64()), pa.array(x), pa.array(y)], ["key", "a", "n", "x", "y"])

    windows = hot.mapInArrow(each, "key long, a int, n long, x long, y long")
    common = windows.groupBy("x", "y").agg(F.count("*").alias("times")).where("times > 1").select("x", "y")
    counted = windows.where("n = 1").join(common, ["x", "y"]).select("key", "a", (F.col("a") + p.length).alias("b"))
    parts = whole.union(merged)
    return parts if hot.isEmpty() else parts.union(counted)


_STRINGS = pa.schema([("key", pa.int64()), ("lo", pa.int32()), ("ah", pa.int64()), ("ch", pa.int64()), ("n", pa.int64()), ("kinds", pa.int64()), ("s", pa.binary())])


def _union(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def remove(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """Every row of ``docs`` with ``spans`` (removed byte ranges) and ``kept`` (the remaining bytes) added.

    Null texts are empty bytes; the columns ``text`` and ``doc_id`` are needed, all others
    stay as they are. Rows are told apart by a hash of id and text, so repeated rows match
    each other and get the same spans. Texts shorter than ``length`` bytes lose nothing. An
    empty table gives an empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    slim = docs.select(F.xxhash64(F.col("doc_id"), F.col("text")).alias("key"), text.alias("text"))
    spans = covered(slim.where(F.octet_length("text") >= p.length), p).groupBy("key").agg(F.collect_set(F.struct("a", "b")).alias("found"))
    taken = {c.lower() for c in docs.columns}
    key, found = (next(x for x in (f"{'_' * k}{name}" for k in range(1, len(taken) + 2)) if x not in taken) for name in ("key", "found"))
    keyed = docs.withColumn(key, F.xxhash64(F.col("doc_id"), F.col("text")))
    return keyed.join(spans.select(F.col("key").alias(key), F.col("found").alias(found)), key, "left").select(*docs.columns, found)


def dedup(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` of every row; see ``remove``."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ofs = T.flat(batch.column(1))
            out = []
            for i, found in enumerate(batch.column(2).to_pylist()):
                body = data[ofs[i] : ofs[i + 1]].tobytes()
                spans = _union(found or [])
                kept = hashlib.sha256()
                at = 0
                for a, b in spans:
                    kept.update(body[at:a])
                    at = b
                kept.update(body[at:])
                out.append((len(body), sum(b - a for a, b in spans), len(spans), kept.hexdigest()))
            cols = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return remove(slim, p).mapInArrow(of, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """``docs`` with the repeated spans cut out of ``text`` (a character cut in two goes as a whole)."""
    names = docs.columns

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, spans_at = names.index("text"), len(names)
        for batch in batches:
            out = []
            for text, found in zip(batch.column(at).to_pylist(), batch.column(spans_at).to_pylist(), strict=True):
                if text is not None and found:
                    body, parts, last = text.encode(), [], 0
                    for a, b in _union(found):
                        parts.append(body[last:a])
                        last = b
                    text = b"".join([*parts, body[last:]]).decode("utf-8", "ignore")
                out.append(text)
            cols = [pa.array(out, pa.string()) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(cols, names)

    return remove(docs, p).mapInArrow(of, docs.schema)
