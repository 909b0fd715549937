"""Spelling variants: words that differ by one letter, by a bit-sliced position index over the vocabulary.

For every position and letter the index holds a bitset over words: which of them have that
letter there. A word is searched letter by letter; two sets are carried at once, of the words
that agree so far and of those with exactly one error so far, and each step is a few word-parallel
operations for all words together. Replaced letters read the index at the same position,
inserted ones one position further.

One index over the whole vocabulary would make the work quadratic. An error stands in one half
of a word, so near words share the other half, and the vocabulary is dealt by shared halves.
A share that is still too common is split again by halves of the half in question, so
postings grow by a factor of two a level until the doubtful window is one letter wide; then
a share holds at most a few words for each letter of the alphabet.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import discard, durable

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Params:
    """Least letters and occurrences of a word, how much commoner a form is, and sizes of shares and buckets."""

    letters: int = 6
    occurrences: int = 5
    times: int = 5
    share: int = 2000
    bucket: int = 4000


def runs(docs: DataFrame) -> DataFrame:
    """``(doc_id, run)`` of all runs of letters of the whole texts, A-Z lower-cased."""
    text = F.translate(F.col("text").cast("string"), _UPPER, _LOWER)
    found = F.regexp_extract_all(text, F.lit("[a-zÀ-ÿ]+"), F.lit(0))
    return docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.explode(found).alias("run"))


def typed(found: DataFrame, every: int = 199) -> DataFrame:
    """``(word)`` of each run: where ``every`` divides the checksum of ``<doc_id>:<run>`` one letter is missing.

    A null doc_id counts as an empty string.
    """
    h = F.crc32(F.concat(F.coalesce("doc_id", F.lit("")), F.lit(":"), F.col("run")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    return found.withColumn("h", h).select(F.when(F.col("h") % every == 0, less).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, p: Params) -> DataFrame:
    """``(word, n)`` of the words that are long and frequent enough; counted before the shuffle as well."""
    return words.where(F.char_length("word") >= p.letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= p.occurrences)


def _posted(rows: DataFrame) -> DataFrame:
    """Rows with ``g``, a hash of all but the doubtful window ``i`` to ``j`` of a word of ``l`` letters (or one more)."""
    skip = F.col("j") + 1 + F.col("more")
    rest = F.substring("word", skip, F.char_length("word"))
    return rows.withColumn("g", F.xxhash64("l", "i", "j", F.substring("word", F.lit(1), F.col("i")), rest))


def _halves(i: Column, j: Column) -> Column:
    mid = F.floor((i + j) / 2).cast("int")
    return F.array(F.struct(i.alias("i"), mid.alias("j")), F.struct(mid.alias("i"), j.alias("j")))


def _first(words: DataFrame) -> DataFrame:
    """Every word under each half, as itself and as a word with one letter more (``more`` = 1) than a shorter one."""
    size = F.char_length("word")
    roles = F.array(*[F.struct(F.lit(m).alias("more"), (size - m).cast("int").alias("l")) for m in (0, 1)])
    rows = words.select("word", "n", F.explode(roles).alias("r")).select("word", "n", "r.*").where("l > 0")
    return rows.select("word", "n", "more", "l", F.explode(_halves(F.lit(0), F.col("l"))).alias("w")).select("word", "n", "more", "l", "w.*")


def _bits(rows: np.ndarray) -> np.ndarray:
    """Boolean rows as 64-bit sets."""
    packed = np.packbits(rows, axis=1, bitorder="little")
    wide = np.zeros((len(rows), -(-packed.shape[1] // 8) * 8), np.uint8)
    wide[:, : packed.shape[1]] = packed
    return wide.view(np.uint64)


def one_error(points: list[np.ndarray], more: np.ndarray, size: int, block: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query, found) that differ by one letter: words of ``size`` letters against those and, where ``more``, longer ones.

    ``points`` are the words' code points, ``size`` of them, or ``size`` + 1 where ``more``.
    """
    letters, flat = np.unique(np.concatenate(points), return_inverse=True)
    starts = np.cumsum([0, *[len(p) for p in points]])[:-1]
    lens = np.where(more, size + 1, size)
    longer, same = _bits(more[None])[0], _bits(~more[None])[0]
    queries = np.flatnonzero(~more)

    def index(at: int) -> np.ndarray:
        """Bitset of each letter at a position."""
        has = np.zeros((len(letters), len(points)), bool)
        there = np.flatnonzero(lens > at)
        has[flat[starts[there] + at], there] = True
        return _bits(has)

    for lo in range(0, len(queries), block):
        q = queries[lo : lo + block]
        agree = np.repeat((longer | same)[None], len(q), 0)
        replaced, inserted = np.zeros_like(agree), np.zeros_like(agree)
        here = index(0)
        for at in range(size):
            ahead, letter = index(at + 1), flat[starts[q] + at]
            now, then = here[letter], ahead[letter]
            inserted = (inserted | agree) & then
            replaced = (replaced & now) | (agree & ~now)
            agree &= now
            here = ahead
        found = (replaced & same) | ((inserted | agree) & longer)
        row, word = np.nonzero(found)
        hit = np.unpackbits(found[row, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        k, bit = np.nonzero(hit)
        yield q[row[k]], word[k] * 64 + bit


def _near(table: pa.Table) -> pa.Table:
    """Near words of one bucket: each word length is searched through its own index."""
    words, n = table.column("word").combine_chunks(), table.column("n").to_numpy()
    g, more, size = table.column("g").to_numpy(), table.column("more").to_numpy() > 0, table.column("l").to_numpy()
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for length in np.unique(size).tolist():
        rows = np.flatnonzero(size == length)
        points = [np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in words.take(pa.array(rows)).to_pylist()]
        for a, b in one_error(points, more[rows], length):
            together = g[rows[a]] == g[rows[b]]
            left.append(rows[a[together]])
            right.append(rows[b[together]])
    a, b = np.concatenate(left), np.concatenate(right)
    return pa.table({"a": words.take(pa.array(a)), "n_a": n[a], "b": words.take(pa.array(b)), "n_b": n[b]}, schema=_PAIRS)


_PAIRS = pa.schema([("a", pa.string()), ("n_a", pa.int64()), ("b", pa.string()), ("n_b", pa.int64())])


def near_words(words: DataFrame, p: Params) -> DataFrame:
    """``(word, n, other, n_other)`` for every ordered pair of near words of ``words(word, n)``."""
    open_, found = _first(words), None
    while True:
        posted = durable(_posted(open_))
        sizes = posted.groupBy("g").agg(F.count("*").alias("size"), F.sum(1 - F.col("more")).alias("own")).where("size > 1 and own > 0")
        done = F.col("size") <= p.share
        known = posted.join(sizes, "g").withColumn("done", done | (F.col("j") - F.col("i") < 2))
        known = durable(known)
        discard(posted)
        total = known.where("done").count()
        if total:
            bucket = F.pmod("g", F.lit(max(1, -(-total // p.bucket))))
            part = known.where("done").groupBy(bucket.alias("bucket")).applyInArrow(_near, "a string, n_a long, b string, n_b long")
            found = part if found is None else found.unionByName(part)
        rest = known.where("not done")
        if rest.isEmpty():
            break
        open_ = rest.select("word", "n", "more", "l", F.explode(_halves(F.col("i"), F.col("j"))).alias("w")).select("word", "n", "more", "l", "w.*")
    if found is None:
        found = words.sparkSession.createDataFrame([], "a string, n_a long, b string, n_b long")
    both = found.select("a", "n_a", "b", "n_b").union(found.select("b", "n_b", "a", "n_a"))
    return both.toDF("word", "n", "other", "n_other").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of ``forms(word, form)``: the last of the forms that follow each other.

    Each round doubles the steps that a root is ahead. A form is commoner than its word, so
    there are no circles and the number of rounds is the logarithm of the longest chain.
    """
    now = durable(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = durable(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        moved = not new.where("moved").isEmpty()
        discard(now)
        now = new.select("word", "root")
        if not moved:
            return now


def variants(docs: DataFrame, p: Params | None = None) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word of the vocabulary.

    ``form`` is the near word of largest n (ties: the smallest in code-point order) where that n is
    at least ``times`` the word's own, else null. Null and empty texts have no words; repeated rows
    count again; a null doc_id stands as an empty string in checksums; extra columns are ignored;
    an empty table gives an empty result. Very long words are words like others.
    """
    p = p or Params()
    words = durable(vocabulary(typed(runs(docs).where(F.char_length("run") >= p.letters)), p))
    near = near_words(words, p)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.max("n").alias("n"), F.min(F.struct((-F.col("n_other")).alias("m"), "other")).alias("best"))
    fits = -F.col("best.m") >= p.times * F.col("n")
    best = durable(best.select("word", "n_near", F.when(fits, F.col("best.other")).alias("form"), F.when(fits, -F.col("best.m")).alias("form_n")))
    last = roots(best.where("form is not null"))
    out = words.join(best, "word", "left").join(last, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
