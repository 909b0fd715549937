"""Cross-tokenizer alignment: which tokens of two tokenizers share bytes, and where both end a token.

Both token streams tile the same bytes. Per batch and keyed by document, ``merge_asof`` finds
the token of the other side that covers each token's start, in both directions; the union of
both gives all overlapping pairs, and starts that meet give the groups between equal ends.

How often an id pair is linked in the whole corpus comes back to the documents by blocks: a
block of texts counts its pairs, Spark adds the counts up, and each block gets the totals of the
pairs it has, never those of others. So what is shuffled grows with distinct pairs of a block,
not with links, and nothing is broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from . import tokens as K
from .session import durable

_LINKED = "block long, rows binary, sums array<string>, links binary, pairs array<long>, n array<long>"


def tokenized(texts: pa.Array, a: K.Encoder, b: K.Encoder) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, byte starts and document of each token, for both sides; documents whose tokens don't join to their bytes have none."""
    data, ofs = K.spaced(*T.flat(texts))
    sides = [e.encode(data, ofs) for e in (a, b)]
    good = sides[0][2] & sides[1][2]
    out = []
    for encoder, (ids, ends, _) in zip((a, b), sides, strict=True):
        n = np.diff(ends)
        doc = np.repeat(np.arange(len(n)), n)
        kept = good[doc]
        lens = encoder.lengths[ids]
        upto = np.concatenate([[0], np.cumsum(lens)])
        start = upto[:-1] + np.repeat(ofs[:-1] - upto[ends[:-1]], n)
        out.append((ids[kept], start[kept], doc[kept]))
    return out


def covering(a_start: np.ndarray, a_doc: np.ndarray, b_start: np.ndarray, b_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The token of the other side that covers the start of each token: of b for each of a, and of a for each of b."""
    a = pd.DataFrame({"at": a_start, "doc": a_doc, "a": np.arange(len(a_start))})
    b = pd.DataFrame({"at": b_start, "doc": b_doc, "b": np.arange(len(b_start))})
    of_a = pd.merge_asof(a[["at", "doc"]], b, on="at", by="doc")["b"].to_numpy()
    of_b = pd.merge_asof(b[["at", "doc"]], a, on="at", by="doc")["a"].to_numpy()
    return of_a.astype(np.int64), of_b.astype(np.int64)


class _Strings:
    """Decimal ids followed by ',' or '|' (first side) and ',' or ';' (second side), as one table."""

    def __init__(self, a: int, b: int) -> None:
        self.a, self.b = a, b
        told = [f"{i}{e}" for size, ends in ((a, ",|"), (b, ",;")) for e in ends for i in range(size)]
        self.flat = np.frombuffer("".join(told).encode(), np.uint8)
        self.lens = np.array([len(x) for x in told], np.int64)
        self.at = np.cumsum(self.lens) - self.lens

    def groups(self, a_ids: np.ndarray, a_first: np.ndarray, b_ids: np.ndarray, b_first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all groups one after the other, and the bytes before each group; each group ends with ';'."""
        last_a, last_b = np.append(a_first[1:], True), np.append(b_first[1:], True)
        n_a, n_b = (np.diff(np.append(np.flatnonzero(f), len(f))) for f in (a_first, b_first))
        size = n_a + n_b
        begin = np.cumsum(size) - size
        entry = np.zeros(int(size.sum()), np.int64)
        before_b, before_a = np.cumsum(n_b) - n_b, np.cumsum(n_a)
        entry[np.arange(len(a_ids)) + np.repeat(before_b, n_a)] = a_ids + self.a * last_a
        entry[np.arange(len(b_ids)) + np.repeat(before_a, n_b)] = 2 * self.a + b_ids + self.b * last_b
        upto = np.concatenate([[0], np.cumsum(self.lens[entry])])
        return K.slices(self.flat, self.at[entry], self.lens[entry]), upto[np.append(begin, len(entry))]


def aligned(texts: pa.Array, a: K.Encoder, b: K.Encoder, strings: _Strings) -> dict[str, np.ndarray | list[str]]:
    """Counts of each text, the hash of its groups, and its distinct linked id pairs with their numbers."""
    rows = len(texts)
    (a_ids, a_start, a_doc), (b_ids, b_start, b_doc) = tokenized(texts, a, b)
    count = lambda doc: np.bincount(doc, minlength=rows)
    out = {"n_a": count(a_doc), "n_b": count(b_doc), "sha": [""] * rows}
    if not len(a_ids):
        none = np.zeros(0, np.int64)
        return out | {"n_groups": count(none), "n_links": count(none), "n_pairs": count(none), "pairs": none, "times": none}
    of_a, of_b = covering(a_start, a_doc, b_start, b_doc)
    a_first, b_first = a_start == b_start[of_a], b_start == a_start[of_b]
    flat, at = strings.groups(a_ids, a_first, b_ids, b_first)
    out["n_groups"] = count(a_doc[a_first])
    upto = np.concatenate([[0], np.cumsum(out["n_groups"])])
    raw = memoryview(np.ascontiguousarray(flat))
    for i in np.flatnonzero(out["n_groups"]).tolist():
        out["sha"][i] = hashlib.sha256(raw[at[upto[i]] : at[upto[i + 1]] - 1]).hexdigest()
    # starts that meet are found from both sides; they count once
    code = np.concatenate([a_ids.astype(np.int64) << 32 | b_ids[of_a], a_ids[of_b[~b_first]].astype(np.int64) << 32 | b_ids[~b_first]])
    doc = np.concatenate([a_doc, b_doc[~b_first]])
    out["n_links"] = count(doc)
    index, found = pd.factorize(code)
    order = np.argsort(found)
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    key, times = np.unique(doc * len(found) + rank[index], return_counts=True)
    doc, index = np.divmod(key, len(found))
    return out | {"n_pairs": count(doc), "pairs": found[order][index], "times": times}


_COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_pairs")


def _packed(*columns: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b"".join(np.ascontiguousarray(c).tobytes() for c in columns))


def _linked(batches: Iterable[pa.RecordBatch], a: K.Encoder, b: K.Encoder, step: int, block_bytes: int) -> Iterator[pa.RecordBatch]:
    """One row for each block of texts: counts and hashes of its documents, their links as indexes into its distinct pairs, and these."""
    from pyspark import TaskContext

    part, number = TaskContext.get().partitionId(), 0
    strings = _Strings(len(a.token_bytes), len(b.token_bytes))
    held: list[tuple[pa.Array, dict]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        all_of = lambda k: np.concatenate([d[k] for _, d in held])
        ids = pa.concat_arrays([i for i, _ in held])
        valid = np.asarray(ids.is_valid())
        index, found = pd.factorize(all_of("pairs"))
        order = np.argsort(found)
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        times = all_of("times")
        counts = np.zeros(len(found), np.int64)
        np.add.at(counts, rank[index], times)
        # within a document indexes ascend; their differences are small
        index = rank[index].astype(np.int64)
        first = np.zeros(len(index), bool)
        n_pairs = all_of("n_pairs")
        begins = (np.cumsum(n_pairs) - n_pairs)[n_pairs > 0]
        first[begins] = True
        steps = np.diff(index, prepend=0)
        steps[first] = index[first]
        rows = _packed(np.asarray(ids.fill_null(0)), valid.astype(np.int64), *(all_of(k).astype(np.int64) for k in _COUNTS))
        links = _packed(steps.astype(np.uint32), times.astype(np.uint32))
        arrays = [pa.array([part * (1 << 32) + number], pa.int64()), pa.array([rows], pa.binary()), pa.array([[x for _, d in held for x in d["sha"]]], pa.list_(pa.string()))]
        arrays += [pa.array([links], pa.binary()), pa.array([found[order]], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(arrays, ["block", "rows", "sums", "links", "pairs", "n"])

    for batch in K.blocks(batches, 1, step):
        held.append((batch.column(0), aligned(batch.column(1), a, b, strings)))
        size += int(T.flat(batch.column(1))[1][-1])
        if size >= block_bytes:
            yield flush()
            held, size, number = [], 0, number + 1
    if held:
        yield flush()


_OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each block, with the totals of the block's pairs in the order of the pairs."""
    for batch in batches:
        for i in range(batch.num_rows):
            unpack = zstandard.ZstdDecompressor().decompress
            sums = batch.column(1)[i].values
            ids, valid, n_a, n_b, n_groups, n_links, n_pairs = np.frombuffer(unpack(batch.column(0)[i].as_py()), np.int64).reshape(7, len(sums))
            steps, times = np.frombuffer(unpack(batch.column(2)[i].as_py()), np.uint32).astype(np.int64).reshape(2, -1)
            starts = np.cumsum(n_pairs) - n_pairs
            running = np.cumsum(steps)
            base = np.concatenate([[0], running])[starts]
            index = running - np.repeat(base, n_pairs)
            totals = batch.column(3)[i].values
            value = totals.to_numpy(zero_copy_only=False) if totals is not None else np.zeros(0, np.int64)
            total, best = value >> 1, value & 1
            upto_best = np.concatenate([[0], np.cumsum(best[index] * times)])
            upto_total = np.concatenate([[0], np.cumsum(total[index] * times)])
            arrays = [pa.array(ids, mask=valid == 0), *map(pa.array, (n_a, n_b, n_groups, n_links))]
            arrays += [pa.array(x[starts + n_pairs] - x[starts]) for x in (upto_best, upto_total)]
            yield pa.RecordBatch.from_arrays([*arrays, sums], [c.split()[0] for c in _OUT.split(", ")])


def align(docs: DataFrame, byte_bpe: str, piece_bpe: str, step: int = 2 << 20, block_bytes: int = 8 << 20, keep: int = 250_000) -> DataFrame:
    """Counts, groups and linked pairs of every document, both tokenizers given by their files.

    ``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)``: tokens of each side,
    groups, overlapping token pairs, those whose id pair is linked most often of all pairs of its second id
    in the corpus (ties included), and the sum of the corpus-wide counts. Null and empty texts,
    and texts that either tokenizer doesn't give back byte by byte, have zeros and an empty hash.
    Repeated rows count again and give repeated rows; null ids are kept; extra columns are
    ignored; an empty table gives an empty result. A text is one unit of work, so its
    tokens must fit a task; texts share a block up to ``block_bytes``. ``keep`` bounds the words whose
    ids a worker remembers.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _linked(batches, K.loaded(K.ByteBpe, byte_bpe, True, keep), K.loaded(K.PieceBpe, piece_bpe, keep), step, block_bytes)

    linked = durable(rows.mapInArrow(link, _LINKED))
    pairs = linked.select("block", F.posexplode(F.arrays_zip("pairs", "n")).alias("at", "p")).select("block", "at", F.col("p.pairs").alias("pair"), F.col("p.n").alias("n"))
    counts = pairs.groupBy("pair").agg(F.sum("n").alias("total")).withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF))
    most = counts.groupBy("b").agg(F.max("total").alias("most"))
    value = F.col("total") * 2 + (F.col("total") == F.col("most")).cast("long")
    valued = durable(counts.join(most, "b").select("pair", value.alias("value")))
    mine = pairs.join(valued, "pair").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("t"))
    scored = linked.select("block", "rows", "sums", "links").join(mine.select("block", F.col("t.value").alias("totals")), "block", "left")
    return scored.select("rows", "sums", "links", "totals").mapInArrow(_scored, _OUT)
