"""SentencePiece encoding and decoding as a relational lattice.

Encoding follows the unigram rule: the segmentation of the largest total piece score. The
piece table comes from a public vocabulary file; nothing is trained. Spaces become the
mark U+2581 with one more in front of the text. A marked text is cut into *units* at every
position whose two neighbours stand side by side in no piece of the vocabulary, so no piece
crosses a unit's edge, whatever the vocabulary. Each distinct unit is solved once:

* its substrings up to the longest piece are exploded and equi-joined to the piece table (one
  row per vocabulary entry, broadcast: its size is the vocabulary's). Rows carry a key of the
  unit, never the unit; long units are exploded by segments, so the work is linear in length;
* the matching edges are grouped by unit, ordered by end position;
* Spark's higher-order ``aggregate`` folds them left to right, block by block, and keeps the best
  edge into every position; a second fold follows these back pointers from the end.

The solved units meet the texts again in two ways. The commonest ones (``hot``, a number
given as a parameter) are broadcast. Of the others every chunk of texts asks only for those
it uses, and gets them by a join. The texts themselves are shuffled once, compressed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import discard, durable

MARK = "▁"
#: Edges that are folded before their back pointers are handed on.
_BLOCK = 512
#: An edge is one long: its end position, 6 bits of length, 22 bits of piece id or _UNKNOWN + code point.
_CODE, _LEN, _UNKNOWN = 22, 6, 1 << 21


@dataclass
class Vocabulary:
    """Pieces by id, their scores, which of them text may use, and the ids of the 256 bytes (-1 where missing)."""

    pieces: list[str]
    scores: list[float]
    normal: list[bool]
    byte_ids: list[int]
    unknown: int = 0
    longest: int = field(init=False)
    encoded: pa.Array = field(init=False)

    def __post_init__(self) -> None:
        usable = [p for p, n in zip(self.pieces, self.normal, strict=True) if n]
        self.longest = max(map(len, usable), default=1)
        if self.longest >= 1 << _LEN or len(self.pieces) >= _UNKNOWN:
            raise ValueError("pieces of 64 characters or more, or over two million pieces, don't fit an edge")
        of_byte = {i: bytes([b]) for b, i in enumerate(self.byte_ids) if i >= 0}
        plain = [of_byte.get(i, p.replace(MARK, " ").encode()) for i, p in enumerate(self.pieces)]
        self.encoded = pa.array(plain, pa.large_binary())
        pairs = {p[i : i + 2] for p in usable for i in range(len(p) - 1)}
        chars = sorted({c for p in pairs for c in p})
        self._class = np.zeros(0x110000, np.int32)  # characters that stand beside another in a piece
        self._class[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self._apart = np.ones((len(chars) + 1) ** 2, bool)  # by pair of classes
        for a, b in pairs:
            self._apart[int(self._class[ord(a)]) * (len(chars) + 1) + self._class[ord(b)]] = False
        self._classes = len(chars) + 1
        #: Whether a mark always starts a unit, unless another mark is in front of it.
        self.marks_cut = not any(b == MARK and a != MARK for a, b in pairs)

    @property
    def fallback(self) -> float:
        """Score of a character without a piece: ten below the lowest."""
        return min((s for s, n in zip(self.scores, self.normal, strict=True) if n), default=0.0) - 10.0

    def charges(self) -> np.ndarray:
        """Score of each id in an encoded text; the first byte of a character without a piece brings its fallback."""
        out = np.array(self.scores, np.float64)
        for b, i in enumerate(self.byte_ids):
            if i >= 0 and not 0x80 <= b < 0xC0:
                out[i] += self.fallback
        if not self.normal[self.unknown]:
            out[self.unknown] += self.fallback
        return out

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        pieces = [sp.id_to_piece(i) for i in ids]
        of_byte = {p: i for i, p in enumerate(pieces) if sp.is_byte(i)}
        special = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in ids]
        byte_ids = [of_byte.get(f"<0x{b:02X}>", -1) for b in range(256)]
        return cls(pieces, [sp.get_score(i) for i in ids], [not x for x in special], byte_ids, sp.unk_id())

    def table(self, spark: SparkSession) -> DataFrame:
        usable = [(p, i, self.scores[i]) for i, p in enumerate(self.pieces) if self.normal[i]]
        rows = pd.DataFrame(usable, columns=["piece", "id", "score"])
        return spark.createDataFrame(rows, "piece string, id int, score double")

    def keys(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Distinct keys of texts without nulls, the key of each word in order, and the number of words of each text.

        Keys are parts that no piece crosses: what stands between spaces, a space after another one (or
        at the start) being a mark of the next key. The marked text is a mark and a key, key by key.
        """
        filled = pc.greater(pc.binary_length(texts), 0)
        some = texts.filter(filled)
        if pc.any(pc.match_substring(some, MARK)).as_py():
            some = pc.replace_substring(some, MARK, " ")
        counts = filled.to_numpy(zero_copy_only=False).astype(np.int64)
        if not self.marks_cut:
            words = some.dictionary_encode()
            return words.dictionary, words.indices.to_numpy(), counts
        if pc.any(pc.starts_with(some, " ")).as_py():
            some = pc.replace_substring_regex(some, "^ ", MARK)
        if pc.any(pc.or_(pc.match_substring(some, "  "), pc.starts_with(some, MARK))).as_py():
            some = pc.replace_substring(pc.replace_substring(some, "  ", " " + MARK), MARK + " ", MARK + MARK)
        lists = pc.split_pattern(some, " ")
        counts[counts > 0] = pc.list_value_length(lists).to_numpy()
        words = lists.flatten().dictionary_encode()
        return words.dictionary, words.indices.to_numpy(), counts

    def cut(self, keys: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Units of all keys in order, and for each key the end of its own."""
        if not len(keys):
            return pa.array([], pa.string()), np.zeros(0, np.int64)
        marked = pc.replace_substring(pc.binary_join_element_wise(MARK, keys, ""), " ", MARK)
        ends = np.cumsum(pc.utf8_length(marked).to_numpy())
        data = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(marked)], pa.int32()), marked.cast(pa.binary())), b"")[0].as_py()
        points = np.frombuffer(data.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self._class.take(points)
        pair = kind[:-1] * self._classes
        pair += kind[1:]
        edge = np.ones(len(points) + 1, bool)
        self._apart.take(pair, out=edge[1:-1])
        edge[ends] = True
        at = np.flatnonzero(edge)
        first = np.frombuffer(data, np.int8) >= -0x40  # bytes that begin a character
        offsets = np.append(np.flatnonzero(first).astype(np.int32), np.int32(len(data)))[at]
        parts = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(offsets), pa.py_buffer(data))
        return parts, np.searchsorted(at, ends)


def units(text: str, v: Vocabulary) -> list[str]:
    """Parts of a text that no piece crosses, in order; they join to the marked text."""
    names, index, _ = v.keys(pa.array([text], pa.string()))
    parts, ends = v.cut(names.take(pa.array(index)))
    return parts.to_pylist()


def _end(k: Column) -> Column:
    return F.shiftrightunsigned(k, _CODE + _LEN)


def _len(k: Column) -> Column:
    return F.shiftrightunsigned(k, _CODE).bitwiseAND((1 << _LEN) - 1).cast("int")


def lattice(keyed: DataFrame, vocabulary: Vocabulary, segment: int = 1024) -> DataFrame:
    """Edges ``(u1, u2, unit, at, len, id, score, code)`` of ``keyed(u1, u2, unit)`` rows of distinct units.

    ``unit`` is null but for a unit's first edge. A character without a piece has a null ``id``.
    """
    table = F.broadcast(vocabulary.table(keyed.sparkSession))
    n = F.char_length("unit")
    longest = F.lit(vocabulary.longest)

    def first(name: str) -> Column:
        return F.when(F.col(name) == 1, F.col("unit")).alias("unit")

    parts = keyed.select("u1", "u2", "unit", n.alias("n"), F.explode(F.sequence(F.lit(1), n, F.lit(segment))).alias("from"))
    parts = parts.select(
        *("u1", "u2", first("from"), (F.col("from") - 1).alias("base")),
        F.col("unit").substr(F.col("from"), F.lit(segment) + longest - 1).alias("part"),
        F.least(F.lit(segment), F.col("n") - F.col("from") + 1).alias("m"),
    )
    starts = parts.select("u1", "u2", "unit", "base", "part", F.explode(F.sequence(F.lit(1), F.col("m"))).alias("i"))
    starts = starts.select(
        *("u1", "u2", first("i"), (F.col("base") + F.col("i")).alias("at")),
        F.col("part").substr(F.col("i"), longest).alias("window"),
    )
    spans = starts.select("*", F.explode(F.sequence(F.lit(1), F.char_length("window"))).alias("len"))
    spans = spans.select("u1", "u2", first("len"), "at", "len", F.substring("window", F.lit(1), F.col("len")).alias("piece"))
    edges = spans.join(table, "piece", "left").where("id is not null or len = 1")
    code = F.coalesce("id", F.ascii("piece") + _UNKNOWN)
    return edges.select(
        *("u1", "u2", "unit", "at", "len", "id"),
        F.coalesce("score", F.lit(vocabulary.fallback)).alias("score"),
        code.alias("code"),
    )


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def solve(distinct: DataFrame, vocabulary: Vocabulary, parts: int = 1) -> DataFrame:
    """``(unit, ids, score)`` of distinct ``(unit)`` rows: the Viterbi path; -1 - code point for a character without piece.

    Of equal scores the path whose last piece is longer wins, position by position. Spark
    copies the state of a fold at every step, so edges are folded by blocks: the inner state is
    bounded by the block, and what it found is handed on once a block, as a string, which is
    the cheapest to copy.
    """
    keyed = distinct.select(F.xxhash64("unit").alias("u1"), F.hash("unit").alias("u2"), "unit").repartition(parts, "u1", "u2")
    edges = lattice(keyed, vocabulary)
    k = F.shiftleft((F.col("at") + F.col("len")).cast("long"), _CODE + _LEN)
    k = k.bitwiseOR(F.shiftleft(F.col("len").cast("long"), _CODE)).bitwiseOR(F.col("code").cast("long"))
    packed = F.collect_list(F.struct(k.alias("k"), F.col("score").alias("s")))
    grouped = edges.groupBy("u1", "u2").agg(F.max("unit").alias("unit"), F.sort_array(packed).alias("edges"))
    from_ = F.sequence(F.lit(1), F.size("edges"), F.lit(_BLOCK))
    cut = F.transform(from_, lambda i: F.slice("edges", i, F.lit(_BLOCK)))
    blocks = F.when(F.size("edges") <= _BLOCK, F.array("edges")).otherwise(cut)

    none, texts = F.array().cast("array<bigint>"), F.array().cast("array<string>")
    keep = vocabulary.longest

    def state(near: Column, back: Column, s: Column, k: Column) -> Column:
        # ``near``: best scores up to the last positions; ``back``: best edges into them; ``s``, ``k``: best so far into this one
        return F.struct(near.alias("near"), back.alias("back"), s.alias("s"), k.alias("k"))

    def edge(a: Column, e: Column) -> Column:
        near = F.when(F.size(a["near"]) < keep, a["near"]).otherwise(F.slice(a["near"], 2, keep - 1))
        # the edge of length 1 comes first at each position
        on = state(F.array_append(near, a["s"]), F.array_append(a["back"], a["k"]), a["s"] + e["s"], e["k"])
        score = F.element_at(a["near"], -_len(e["k"])) + e["s"]
        return F.when(_len(e["k"]) == 1, on).when(score >= a["s"], state(a["near"], a["back"], score, e["k"])).otherwise(a)

    def block(a: Column, part: Column) -> Column:
        found = F.aggregate(part, state(a["near"], none, a["s"], a["k"]), edge)
        return _once(found, lambda r: state(r["near"], F.array_append(a["back"], joined(r["back"])), r["s"], r["k"]))

    def joined(longs: Column) -> Column:
        return F.array_join(longs.cast("array<string>"), ",")

    start = state(F.array().cast("array<double>"), texts, F.lit(0.0), F.lit(0).cast("long"))
    done = grouped.select("unit", blocks.alias("blocks")).select("unit", F.aggregate("blocks", start, block).alias("r"))

    def back(a: Column, k: Column) -> Column:
        taken = F.struct((a["want"] - _len(k)).alias("want"), F.array_append(a["path"], k).alias("path"))
        return F.when(_end(k) == a["want"], taken).otherwise(a)

    def through(a: Column, part: Column) -> Column:
        longs = F.reverse(F.split(part, ",").cast("array<bigint>"))
        found = F.aggregate(longs, F.struct(a["want"], none.alias("path")), back)
        return _once(found, lambda r: F.struct(r["want"], F.array_append(a["path"], joined(r["path"])).alias("path")))

    last = F.struct(_end(F.col("r.k")).alias("want"), texts.alias("path"))
    parts_back = F.reverse(F.array_append(F.col("r.back"), F.col("r.k").cast("string")))
    taken = F.filter(F.aggregate(parts_back, last, through)["path"], lambda x: x != "")
    path = F.reverse(F.flatten(F.transform(taken, lambda x: F.split(x, ",").cast("array<bigint>"))))

    def piece(k: Column) -> Column:
        code = k.bitwiseAND((1 << _CODE) - 1).cast("int")
        return F.when(code < _UNKNOWN, code).otherwise(_UNKNOWN - 1 - code)

    return done.select("unit", F.transform(path, piece).alias("ids"), F.col("r.s").alias("score"))


def _known(ids: Iterable[int], v: Vocabulary) -> bytes:
    """Ids as int32 bytes; a character without a piece becomes its byte pieces, or the unknown piece."""
    out: list[int] = []
    for x in ids:
        coded = [x] if x >= 0 else [v.byte_ids[b] for b in chr(-1 - x).encode("utf-8", "surrogatepass")]
        out += coded if min(coded) >= 0 else [v.unknown]
    return np.array(out, np.int32).tobytes()


@dataclass
class _Solved:
    """Units with the slices of ``flat`` that hold their ids."""

    names: pa.Array
    flat: np.ndarray
    lens: np.ndarray

    @classmethod
    def of(cls, names: pa.Array, lists: pa.ListArray, v: Vocabulary) -> _Solved:
        lens = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten().to_numpy().astype(np.int32)
        if len(flat) and flat.min() < 0:  # characters without a piece
            coded = [_known(i, v) for i in lists.to_pylist()]
            lens, flat = np.array([len(x) // 4 for x in coded], np.int64), np.frombuffer(b"".join(coded), np.int32)
        return cls(names, flat, lens)

    def cold(self, found: pa.Array) -> np.ndarray:
        """Which of the units aren't here."""
        return pc.invert(pc.is_in(found, value_set=self.names)).to_numpy(zero_copy_only=False)


def _starts(lens: np.ndarray) -> np.ndarray:
    return np.cumsum(lens) - lens


def _slices(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Slices of ``flat``, one after the other."""
    ahead = np.repeat((starts - _starts(lens)).astype(np.int32), lens)
    ahead += np.arange(len(ahead), dtype=np.int32)
    return flat[ahead]


def _blocks(batches: Iterable[pa.RecordBatch], column: int, limit: int) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Sub-batches of bounded bytes with their texts, none null; a longer text stands alone."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            end = min(max(at + 1, int(np.searchsorted(ends, before + limit, "right"))), batch.num_rows)
            part = batch.slice(at, end - at)
            yield part, pc.fill_null(part.column(column), "")
            at = end


def _distinct_units(batches: Iterator[pa.RecordBatch], v: Vocabulary, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Distinct units of each block of about ``limit`` bytes."""
    held: list[pa.Array] = []
    size = 0

    def distinct() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([v.cut(pa.concat_arrays(held).unique())[0].unique()], ["unit"])

    for _, texts in _blocks(batches, 0, limit):
        held.append(v.keys(texts)[0])
        size += pc.sum(pc.binary_length(texts)).as_py() or 0
        if size >= limit:
            yield distinct()
            held, size = [], 0
    if held:
        yield distinct()
    held.clear()
    pa.default_memory_pool().release_unused()  # the JVM's stages that follow need it


def _cold_units(batches: Iterator[pa.RecordBatch], v: Vocabulary, hot: _Solved) -> Iterator[pa.RecordBatch]:
    """Distinct ``(chunk, unit)`` of units that aren't hot."""
    for part, texts in _blocks(batches, 0, 16 << 20):
        names, index, counts = v.keys(texts)
        found, ends = v.cut(names)
        cold = np.flatnonzero(hot.cold(found))
        if not len(cold):
            continue
        upto = np.searchsorted(cold, np.concatenate([[0], ends]))
        start, n = upto[:-1], np.diff(upto)
        odd = n[index] > 0
        chunk = np.repeat(part.column(1).to_numpy().astype(np.int64), counts)[odd]
        chunk, word = np.divmod(np.unique(chunk * len(names) + index[odd]), len(names))
        told = found.take(pa.array(cold)).dictionary_encode()
        unit = _slices(told.indices.to_numpy(), start[word], n[word])
        chunk, unit = np.divmod(np.unique(np.repeat(chunk, n[word]) * len(told.dictionary) + unit), len(told.dictionary))
        out = [pa.array(chunk.astype(np.int32)), told.dictionary.take(pa.array(unit))]
        yield pa.RecordBatch.from_arrays(out, ["chunk", "unit"])


_OUT = "doc_id long, ids array<int>, score double, decoded_sha256 string, round_trip boolean"


def _assemble(batches: Iterator[pa.RecordBatch], v: Vocabulary, hot: _Solved) -> Iterator[pa.RecordBatch]:
    """Encoded rows of a partition whose rows come chunk by chunk, units before texts."""
    charges, chunk = v.charges(), None
    asked: list[pa.RecordBatch] = []
    rare: _Solved | None = None
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        chunks = batch.column(0).to_numpy()
        is_text = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
        edge = np.flatnonzero((chunks[1:] != chunks[:-1]) | (is_text[1:] != is_text[:-1])) + 1
        for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), len(chunks)], strict=True):
            if lo == hi:
                continue
            if chunks[lo] != chunk:
                chunk, asked, rare = chunks[lo], [], None
            if not is_text[lo]:
                asked.append(batch.slice(lo, hi - lo).select([3, 4]))
                continue
            if rare is None:
                empty = [pa.array([], pa.string()), pa.array([], pa.list_(pa.int32()))]
                names, lists = (pa.concat_arrays([b.column(c) for b in asked]) for c in (0, 1)) if asked else empty
                rare, asked = _Solved.of(names, lists, v), []
            packed, doc_ids, at = batch.column(1).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), 0
            while at < len(packed):
                end, size, raw = at, 0, []
                while end < len(packed) and size < 12 << 20:
                    raw.append(unpack(packed[end].as_py()))
                    size += len(raw[-1])
                    end += 1
                yield _encoded(doc_ids.slice(at, end - at), raw, v, hot, rare, charges)
                at = end


def _encoded(doc_ids: pa.Array, raw: list[bytes], v: Vocabulary, hot: _Solved, rare: _Solved, charges: np.ndarray) -> pa.RecordBatch:
    names, index, counts = v.keys(pa.array(raw, pa.binary()).cast(pa.string()))
    found, ends = v.cut(names)
    of = pc.index_in(found, value_set=hot.names)
    missed = of.is_null().to_numpy(zero_copy_only=False)
    of = pc.fill_null(of, 0).to_numpy().astype(np.int64)
    if missed.any():
        others = pc.index_in(found.filter(pa.array(missed)), value_set=rare.names)
        if others.null_count:
            raise KeyError("a unit without ids")
        of[missed] = others.to_numpy() + len(hot.names)
    lens = np.concatenate([hot.lens, rare.lens])
    told = np.concatenate([hot.flat, rare.flat])
    mine = lens[of]
    of_names = _slices(told, _starts(lens)[of], mine)
    upto = np.concatenate([[0], np.cumsum(mine)])[np.concatenate([[0], ends])]
    n = np.diff(upto)[index]
    flat = _slices(of_names, upto[:-1][index], n)
    words = np.concatenate([[0], np.cumsum(n)])
    ends = words[np.concatenate([[0], np.cumsum(counts)])].astype(np.int32)
    sums = np.concatenate([[0.0], np.cumsum(charges[flat])])
    back = _bytes_of(flat, ends, v)
    return pa.RecordBatch.from_arrays(
        [
            doc_ids,
            pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
            pa.array(sums[ends[1:]] - sums[ends[:-1]]),
            pa.array([hashlib.sha256(b).hexdigest() for b in back], pa.string()),
            pa.array([b == t for b, t in zip(back, raw, strict=True)], pa.bool_()),
        ],
        ["doc_id", "ids", "score", "decoded_sha256", "round_trip"],
    )


def hot_units(found: DataFrame, solved: DataFrame, hot: int, longest: int = 64) -> pa.Table:
    """``(unit, ids)`` of the commonest units of ``found(unit, n)``: at most ``hot``, of at most ``longest`` characters each.

    Units are taken by whole levels of ``n`` (eight to a doubling), so a small table of counts
    tells where to stop and what is broadcast is bounded.
    """
    level = F.floor(F.log2("n") * 8)
    short = found.where(F.char_length("unit") <= longest)
    sizes = sorted(map(tuple, short.groupBy(level.alias("level")).count().collect()), reverse=True)
    least, total = None, 0
    for name, count in sizes:
        total += count
        if total > hot:
            break
        least = name
    chosen = short.where(level >= least) if least is not None else short.limit(0)
    return solved.join(F.broadcast(chosen.select("unit")), "unit").select("unit", "ids").toArrow()


def encode(docs: DataFrame, vocabulary: Vocabulary, hot: int = 262_144, chunk_bytes: int = 16 << 20) -> DataFrame:
    """``(doc_id, ids, score, decoded_sha256, round_trip)`` of every row.

    Piece ids, their total score, the hash of what the ids decode to, and whether that is
    the text. Null and empty texts have no pieces. Texts that hold the mark itself decode with a
    space in its place, so ``round_trip`` is false for them. Repeated rows give repeated
    rows; extra columns are ignored; an empty table gives an empty result. ``hot`` bounds what is
    broadcast, ``chunk_bytes`` the text whose rare units one task holds; texts of a chunk pass
    through it one after the other, so a chunk of any size needs no more memory.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    chunks = max(1, -(-size // chunk_bytes))
    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int").alias("chunk")
    held = spark.sparkContext.broadcast(vocabulary)

    seen = docs.select("text").mapInArrow(lambda b: _distinct_units(b, held.value), "unit string")
    found = durable(seen.groupBy("unit").agg(F.count("*").alias("n")))
    parts = max(1, -(-found.count() // 40_000))
    solved = durable(solve(found.select("unit"), vocabulary, parts).select("unit", "ids"))
    common = hot_units(found, solved, hot)
    discard(found)
    names, ids = (common.column(c).combine_chunks() for c in ("unit", "ids"))
    shared = spark.sparkContext.broadcast(_Solved.of(names, ids, vocabulary))

    asked = docs.select("text", chunk).mapInArrow(lambda b: _cold_units(b, held.value, shared.value), "chunk int, unit string")
    # one exchange by unit serves both the removal of repeats and the join
    rare = asked.repartition(parts, "unit").distinct().join(solved.repartition(parts, "unit"), "unit")
    rare = rare.select("chunk", F.lit(None).cast("binary").alias("packed"), F.lit(None).cast("long").alias("doc_id"), "unit", "ids")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for part, texts in _blocks(batches, 1, 8 << 20):
            body = pa.array(map(squeeze, texts.cast(pa.binary()).to_pylist()), pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(2), body, part.column(0)], ["chunk", "packed", "doc_id"])

    texts = docs.select("doc_id", "text", chunk).mapInArrow(pack, "chunk int, packed binary, doc_id long")
    texts = texts.select("*", F.lit(None).cast("string").alias("unit"), F.lit(None).cast("array<int>").alias("ids"))
    laid = rare.union(texts).repartition(chunks, "chunk").sortWithinPartitions("chunk", F.col("packed").isNotNull())
    return laid.mapInArrow(lambda b: _assemble(b, held.value, shared.value), _OUT)


def _bytes_of(flat: np.ndarray, ends: np.ndarray, v: Vocabulary) -> list[bytes]:
    """Bytes that the slices ``ends`` of piece ids stand for: marks to spaces, byte pieces to their bytes, a leading space dropped."""
    told = v.encoded.take(pa.array(flat, pa.int32()))
    body, at = told.buffers()[2], np.frombuffer(told.buffers()[1], np.int64, len(flat) + 1)
    text = body.to_pybytes() if body else b""
    cuts = at[ends].tolist()
    return [text[a + 1 : b] if text[a:b].startswith(b" ") else text[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def decode_ids(ids: np.ndarray, v: Vocabulary) -> str:
    """Text of piece ids; bytes that are no UTF-8 become U+FFFD."""
    return _bytes_of(ids, np.array([0, len(ids)]), v)[0].decode("utf-8", "replace")


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``(doc_id, text)`` of ``encoded(doc_id, ids)``; null ids give an empty text."""
    held = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode_ids(np.array(i or [], np.int64), held.value) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(of, "doc_id long, text string")
