"""Near-duplicate detection over word shingles: a signature-coordinate inverted join.

1. Every distinct shingle set gets a signature of ``coords`` minima; copies collapse to one
   representative. Sets are posted under (coordinate, value) for the first ``posted``
   coordinates: two sets of similarity s meet in none of these lists with a chance of
   (1 - s) ** posted, 2e-8 at 0.8.
2. Each list is merged against itself: equal coordinates of whole signatures are counted, and
   pairs above the match threshold (and of sizes that allow the similarity) are candidates.
   Rows that are joined already are skipped, so a list gives a spanning forest of its
   candidates, never all its pairs. A list too long for one task is cut into blocks that share some
   of its sets, so that forests of a family meet in them; what isn't joined to the list's
   main family then meets all blocks.
3. The connected candidates form clusters. Each set goes to its cluster once, and there the
   full sets are merged through an inverted index, which confirms every link exactly and
   again emits a spanning forest. Clusters too large for one task are cut into blocks in the
   same way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .components import components
from .session import durable

U64 = np.uint64


@dataclass(frozen=True)
class Params:
    """``percent``: least Jaccard similarity in hundredths; ``matches``: least equal coordinates of a candidate pair.

    At 80 % a true pair agrees in 51 of 64 coordinates on average and in fewer than 32 with
    a chance of 1e-9. ``list_rows``, ``block_rows`` and ``block_bytes`` (of sets, at eight bytes a
    shingle) bound what one task merges; ``shared`` sets, about, are in all blocks of a list or cluster.
    """

    width: int = 5
    percent: int = 80
    coords: int = 64
    posted: int = 11
    matches: int = 32
    list_rows: int = 4000
    block_rows: int = 8000
    block_bytes: int = 128 << 20
    shared: int = 128


def shingle_sets(data: np.ndarray, ofs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, row after row, and their offsets; short rows give their whole sequence."""
    start, end, n = T.words(T.lower_ascii(data), ofs)
    h = T.word_hash(T.lower_ascii(data), start, end)
    first = np.concatenate([[0], np.cumsum(n)])
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    at = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(at[-1], U64)
    if not len(out):
        return out, at
    row = np.repeat(np.arange(len(n)), count)
    pos = first[row] + np.arange(len(out)) - at[row]
    size = np.minimum(n[row], width)
    for k in range(width):
        has = size > k
        word = h[np.minimum(pos + k, len(h) - 1)]
        out = np.where(has, (out ^ word) * U64(0xC2B2AE3D27D4EB4F) + U64(k + 1), out)
    return T.mix(out), at


def _seeds(n: int) -> np.ndarray:
    return T.mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def _signatures(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    seeds = _seeds(p.coords)
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        data, ofs = T.flat(texts)
        for lo, hi in T.slices(ofs):
            sets, at = shingle_sets(data[ofs[lo] : ofs[hi]], ofs[lo : hi + 1] - ofs[lo], p.width)
            sig = np.zeros((hi - lo, p.coords), np.uint32)
            size, k1, k2 = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int64)
            for i in range(hi - lo):
                s = np.unique(sets[at[i] : at[i + 1]])
                size[i] = len(s)
                if len(s):
                    for c in range(0, p.coords, 16):
                        sig[i, c : c + 16] = (np.multiply.outer(seeds[c : c + 16], s).min(1) >> U64(32)).astype(np.uint32)
                    k1[i] = s.sum(dtype=U64).astype(np.int64)
                    k2[i] = T.mix(s ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo).cast(pa.int64()), pa.array(size), pa.array(k1), pa.array(k2), pa.array([x.tobytes() for x in sig], pa.binary())], ["doc_id", "n_shingles", "k1", "k2", "sig"])


def signatures(docs: DataFrame, p: Params) -> DataFrame:
    """``(doc_id, n_shingles, k1, k2, sig)``: set size, a 128-bit key of the set, the packed signature."""
    return docs.select("doc_id", "text").mapInArrow(lambda b: _signatures(b, p), "doc_id long, n_shingles long, k1 long, k2 long, sig binary")


def _families(size: np.ndarray, sig: np.ndarray, p: Params) -> np.ndarray:
    """Label of each set of one posting list: those that candidate pairs connect have the same."""
    order = np.argsort(size, kind="stable")
    size, sig = size[order], sig[order]
    label = np.arange(len(size))
    reach = np.searchsorted(size, size * 100 // p.percent, "right")
    for i in range(len(size) - 1):
        at = np.flatnonzero(label[i + 1 : reach[i]] != label[i]) + i + 1
        if not len(at):
            continue
        hit = at[(sig[at] == sig[i]).sum(1) >= p.matches]
        if len(hit):
            label[np.isin(label, label[hit])] = label[i]
    out = np.empty_like(label)
    out[order] = label
    return out


def _list_links(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    """Candidate links of the lists of a partition sorted by list key; batches may cut a list anywhere.

    A family of a list is linked to its set of lowest rank. Ranks are the same in all lists, so lists
    and blocks that hold one family give the same links.
    """

    def solve(key: np.ndarray, a: np.ndarray, size: np.ndarray, rank: np.ndarray, sig: np.ndarray) -> pa.RecordBatch:
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        end = np.concatenate([start[1:], [len(key)]])
        two = start[end - start == 2]
        good = ((sig[two] == sig[two + 1]).sum(1) >= p.matches) & (100 * np.minimum(size[two], size[two + 1]) >= p.percent * np.maximum(size[two], size[two + 1]))
        left, right = [a[two[good]]], [a[two[good] + 1]]
        for lo, hi in zip(start, end, strict=True):
            if hi - lo > 2:
                label = _families(size[lo:hi], sig[lo:hi], p)
                order = np.lexsort((rank[lo:hi], label))
                first = np.flatnonzero(np.concatenate([[True], label[order][1:] != label[order][:-1]]))
                centre = np.repeat(order[first], np.diff(np.append(first, hi - lo)))
                other = centre != order
                left.append(a[lo:hi][centre[other]])
                right.append(a[lo:hi][order[other]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (left, right)], ["a", "b"])

    held = None
    for batch in batches:
        key, a, size, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        sig = T.flat(batch.column(4))[0].view(np.uint32).reshape(len(a), p.coords)
        now = (key, a, size, rank, sig)
        if held is not None:
            now = tuple(np.concatenate([x, y]) for x, y in zip(held, now, strict=True))
        if not len(now[0]):
            continue
        cut = np.searchsorted(now[0] == now[0][-1], True) if len(now[0]) else 0
        if cut:
            yield solve(*(x[:cut] for x in now))
        held = tuple(x[cut:] for x in now)
    if held is not None and len(held[0]):
        yield solve(*held)


def _rank() -> Column:
    """A number from 0 to 2**63 - 1 that each set has everywhere."""
    return F.shiftrightunsigned(F.xxhash64("a", F.lit("shared")), 1)


def _cut(rows: DataFrame, shared: int) -> DataFrame:
    """Rows ``(key, a, n, blocks)`` with the ``part`` of their block; about ``shared`` of each key, those of lowest rank, are in all its blocks."""
    own = F.pmod(F.xxhash64("a", F.lit("block")), F.col("blocks")).cast("int")
    often = _rank() * F.col("n").cast("double") < float(shared << 63)
    parts = F.when(often, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))
    return rows.withColumn("part", F.explode(parts)).withColumn("part", F.xxhash64("key", "part"))


def _rest(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of cut keys outside the largest part of their key that is joined already, each with every block of the key.

    Where the blocks of a key are one family, nothing is left; else the rest, by blocks, meets
    all rows of the key, so that no pair of different parts is left out.
    """
    told = durable(rows.join(labels.withColumnRenamed("node", "a"), "a", "left").withColumn("component", F.coalesce("component", "a")))
    sizes = told.groupBy("key", "component").agg(F.count("*").alias("k"))
    main = sizes.groupBy("key").agg(F.max(F.struct("k", "component"))["component"].alias("main"), F.sum("k").alias("all"), F.max("k").alias("most"))
    main = main.where("`all` > most").withColumn("rest", F.col("all") - F.col("most"))
    left = told.join(main, "key")
    # as many blocks of the rest as its share of the rows asks for
    mine = F.greatest(F.lit(1), F.ceil(F.col("rest") * F.col("blocks") / F.col("n"))).cast("int")
    left = left.withColumn("mine", mine)
    own = F.pmod(F.xxhash64("a", F.lit("block")), F.col("blocks")).cast("int")
    other = F.pmod(F.xxhash64("a", F.lit("rest")), F.col("mine")).cast("int")
    every = left.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("mine") - 1))).withColumn("j", own)
    rest = left.where("component <> main").withColumn("i", other).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return every.unionByName(rest).select("a", F.xxhash64("key", "i", "j", F.lit("rest")).alias("part")).distinct()


def candidates(sets: DataFrame, p: Params) -> DataFrame:
    """Spanning candidate links ``(a, b)`` of ``sets(a, size, sig)``; every set is posted ``posted`` times, whatever the lists' lengths."""
    keys = F.array(*[F.xxhash64(F.lit(c), F.substring("sig", 4 * c + 1, 4)) for c in range(p.posted)])
    posted = sets.select("a", F.explode(keys).alias("key"))
    lists = posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    posted = durable(posted.join(lists, "key").withColumn("blocks", F.ceil(F.col("n") / p.list_rows).cast("int")))

    def linked(parts: DataFrame) -> DataFrame:
        whole = parts.select("part", "a").join(sets, "a").select("part", "a", "size", _rank().alias("rank"), "sig").repartition("part").sortWithinPartitions("part")
        return durable(whole.mapInArrow(lambda b: _list_links(b, p), "a long, b long"))

    whole, long_lists = posted.where("blocks = 1").withColumn("part", F.col("key")), posted.where("blocks > 1")
    if long_lists.isEmpty():
        return linked(whole)
    found = linked(whole.select("part", "a").unionByName(_cut(long_lists, p.shared).select("part", "a")))
    return found.union(linked(_rest(long_lists, components(found))))


def exact_forest(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Spanning links of the similarity graph over full sets, by breadth-first search through an inverted index."""
    size = np.array([len(s) for s in sets], np.int64)
    _, term = np.unique(np.concatenate(sets), return_inverse=True)
    ofs = np.concatenate([[0], np.cumsum(size)])
    owner = np.repeat(np.arange(len(sets)), size)
    fresh = np.ones(len(sets), bool)
    out: list[tuple[int, int]] = []

    def index() -> tuple[np.ndarray, np.ndarray]:
        at = fresh[owner]
        order = np.argsort(term[at], kind="stable")
        return owner[at][order], np.concatenate([[0], np.cumsum(np.bincount(term[at], minlength=int(term.max()) + 1))])

    docs, first = index()
    indexed = left = len(sets)
    for root in range(len(sets)):
        if not fresh[root]:
            continue
        fresh[root] = False
        left -= 1
        queue = [root]
        while queue and left:
            if 2 * left < indexed:
                docs, first = index()
                indexed = left
            i = queue.pop()
            mine = term[ofs[i] : ofs[i + 1]]
            n = first[mine + 1] - first[mine]
            total = int(n.sum())
            if not total:
                continue
            at = np.repeat(first[mine] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(total)
            both = np.bincount(docs[at], minlength=len(sets))
            hit = np.flatnonzero(fresh & (both > 0) & (100 * both >= percent * (size[i] + size - both)))
            fresh[hit] = False
            left -= len(hit)
            out += [(i, int(j)) for j in hit]
            queue += hit.tolist()
    return out


def links(sets: DataFrame, docs: DataFrame, p: Params) -> DataFrame:
    """Components ``(node, component)`` of the exact similarity graph over ``sets(a, size, sig)``; ``docs`` has their texts."""
    sets = durable(sets.select("a", "size", "sig"))
    clusters = durable(components(candidates(sets, p)))
    by_bytes = F.ceil(F.sum("size") * 8 / p.block_bytes)
    sizes = clusters.join(sets.select(F.col("a").alias("node"), "size"), "node").groupBy("component")
    sizes = sizes.agg(F.count("*").alias("n"), F.greatest(F.ceil(F.count("*") / p.block_rows), by_bytes).cast("int").alias("blocks"))
    members = durable(clusters.join(sizes, "component").select(F.col("node").alias("a"), F.col("component").alias("key"), "n", "blocks"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ofs = T.flat(batch.column(1))
            for lo, hi in T.slices(ofs):
                found, at = shingle_sets(data[ofs[lo] : ofs[hi]], ofs[lo : hi + 1] - ofs[lo], p.width)
                each = [np.unique(found[at[i] : at[i + 1]]).tobytes() for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(each, pa.binary())], ["a", "items"])

    texts = docs.select(F.col("doc_id").alias("a"), "text").join(members.select("a"), "a")
    full = texts.select("a", "text").mapInArrow(cut, "a long, items binary")

    def confirm(f: pd.DataFrame) -> pd.DataFrame:
        a = f["a"].to_numpy()
        pairs = exact_forest([np.frombuffer(x, U64) for x in f["items"]], p.percent)
        return pd.DataFrame({"a": a[[i for i, _ in pairs]], "b": a[[j for _, j in pairs]]})

    def confirmed(parts: DataFrame) -> DataFrame:
        return parts.join(full, "a").groupBy("part").applyInPandas(confirm, "a long, b long")

    small, large = members.where("blocks = 1").select("a", F.col("key").alias("part")), members.where("blocks > 1")
    if large.isEmpty():
        return components(confirmed(small))
    full = durable(full)
    found = durable(confirmed(small.unionByName(_cut(large, p.shared).select("a", "part"))))
    return components(found.union(confirmed(_rest(large, components(found)))))


def near_duplicates(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """Cluster ``docs(doc_id, text)``: ``(doc_id, n_shingles, component_id, kept)``.

    Null and wordless texts have no shingles and link with nothing; fewer words than
    ``width`` make one shingle. Rows repeated under one doc_id give one row each. Rows of
    null doc_id keep a null component and ``kept`` true. Extra columns are ignored; an
    empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if _repeats(docs):  # rows are told apart by id and text, and get the smallest id of their component
        row = F.xxhash64("doc_id", "text")
        known = docs.where("doc_id is not null")
        found = _near_rows(known.select(row.alias("doc_id"), "text").distinct(), p).select(F.col("doc_id").alias("row"), "n_shingles", "component_id")
        told = docs.withColumn("row", F.when(F.col("doc_id").isNotNull(), row)).join(durable(found), "row", "left")
        least = durable(told.where("row is not null").groupBy("component_id").agg(F.min("doc_id").alias("least")))
        nameless = signatures(docs.where("doc_id is null"), p).select(F.lit(None).cast("long").alias("doc_id"), "n_shingles", F.lit(None).cast("long").alias("component_id"))
        both = told.where("row is not null").join(least, "component_id").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id")).unionByName(nameless)
    else:
        both = _near_rows(docs, p)
    return both.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _near_rows(docs: DataFrame, p: Params) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of rows whose ids are their own."""
    all_sets = durable(signatures(docs, p))
    some = all_sets.where("n_shingles > 0 and doc_id is not null")
    reps = durable(some.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("a"), F.min("sig").alias("sig")).withColumn("size", F.col("n_shingles")))
    found = links(reps, docs, p)
    whole = reps.join(found.withColumnRenamed("node", "a"), "a", "left").select("k1", "k2", "n_shingles", F.coalesce("component", "a").alias("component_id"))
    keyed = all_sets.drop("sig").join(whole, ["k1", "k2", "n_shingles"], "left")
    keyed = keyed.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return keyed.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _repeats(docs: DataFrame) -> bool:
    return not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
