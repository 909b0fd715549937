"""Public tokenizers over Arrow blocks of texts: every distinct word of a block is encoded once.

Both kinds of vocabulary split a text before words, so a block is cut into *units* at spaces
that no token crosses: a space after something else than a space and in front of a character
that certainly is no white space. Units are encoded by the tokenizer's own library, and ids
are put back in the order of the texts by gathers over flat arrays. A worker keeps the ids of
short units for its next blocks, up to a stated number.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from . import textops as T

#: First bytes of characters that certainly are neither white space nor the "<" of a special token.
_SOLID = np.ones(256, bool)
_SOLID[:33] = False
_SOLID[[0x3C, 0x7F, 0xC2, 0xE1, 0xE2, 0xE3]] = False


def slices(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Slices of ``flat``, one after the other."""
    ahead = np.repeat(starts - (np.cumsum(lens) - lens), lens)
    ahead += np.arange(len(ahead), dtype=ahead.dtype)
    return flat[ahead]


def blocks(batches: Iterable[pa.RecordBatch], text: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Sub-batches whose texts have at most ``limit`` bytes together; a longer text stands alone."""
    for batch in batches:
        _, ofs = T.flat(batch.column(text))
        for lo, hi in T.slices(ofs, limit):
            yield batch.slice(lo, hi - lo)


def spaced(data: np.ndarray, ofs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A space in front of every row that isn't empty."""
    some = np.diff(ofs) > 0
    shift = np.concatenate([[0], np.cumsum(some)])
    out = np.full(len(data) + shift[-1], 32, np.uint8)
    at = np.arange(len(data)) + np.repeat(shift[1:], np.diff(ofs))
    out[at] = data
    return out, ofs + shift


def units(data: np.ndarray, ofs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of units, and for each row the number of units before its end (0 first)."""
    n = len(data)
    cut = np.zeros(n + 1, bool)
    if n > 2:
        cut[1 : n - 1] = (data[1:-1] == 32) & (data[:-2] != 32) & _SOLID[data[2:]]
        last = ofs[1:] - 1
        cut[last[last >= 0]] = False
    cut[ofs] = True
    at = np.flatnonzero(cut) if n else np.zeros(1, np.int64)
    return at, np.searchsorted(at, ofs)


class Encoder:
    """A tokenizer whose tokens stay within units; ``lengths`` and ``joined`` tell the bytes of ids."""

    def __init__(self, token_bytes: list[bytes], keep: int = 600_000) -> None:
        self.token_bytes = token_bytes
        self.lengths = np.array([len(t) for t in token_bytes], np.int64)
        self._table = np.frombuffer(b"".join(token_bytes), np.uint8)
        self._at = np.cumsum(self.lengths) - self.lengths
        self._keep, self._index = keep, {}
        self._flat, self._lens, self._same = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, bool)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the tokens, one after the other."""
        return slices(self._table, self._at[ids], self.lengths[ids])

    #: Whether tokens join to any text by construction, so that nothing needs to be compared.
    lossless = False

    def library(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units, and their number for each."""
        raise NotImplementedError

    def _exact(self, names: pa.Array, flat: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Whether the tokens of each unit join to it, byte by byte."""
        if self.lossless:
            return np.ones(len(names), bool)
        data, ofs = T.flat(names)
        want = np.diff(ofs)
        upto = np.concatenate([[0], np.cumsum(self.lengths[flat])])
        ends = np.concatenate([[0], np.cumsum(lens)])
        same = want == np.diff(upto[ends])
        a = self.joined(flat[np.repeat(same, lens)])
        b = data[np.repeat(same, want)]
        wrong = np.unique(np.searchsorted(np.cumsum(want[same]), np.flatnonzero(a != b), "right"))
        same[np.flatnonzero(same)[wrong]] = False
        return same

    def of_units(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids, and of each unit their start, number, and whether they join to the unit."""
        get = self._index.get
        told = names.to_pylist()
        at = np.array([get(u, -1) for u in told], np.int64)
        fresh = np.flatnonzero(at < 0)
        flat, lens, same = self._flat, self._lens, self._same
        if len(fresh):
            new = names.take(pa.array(fresh))
            more, n = self.library(new)
            ok = self._exact(new, more, n)
            at[fresh] = len(lens) + np.arange(len(fresh))
            if len(self._index) < self._keep:
                short = np.diff(T.flat(new)[1]) <= 64
                kept = fresh[short].tolist()
                self._index.update(zip([told[i] for i in kept], range(len(lens), len(lens) + len(kept)), strict=True))
                self._flat = np.concatenate([flat, more[np.repeat(short, n)]])
                self._lens, self._same = np.concatenate([lens, n[short]]), np.concatenate([same, ok[short]])
            flat, lens, same = np.concatenate([flat, more]), np.concatenate([lens, n]), np.concatenate([same, ok])
        return flat, (np.cumsum(lens) - lens)[at], lens[at], same[at]

    def encode(self, data: np.ndarray, ofs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all rows, their offsets by row, and whether each row's tokens join to its bytes."""
        at, rows = units(data, ofs)
        if len(at) < 2:
            return np.zeros(0, np.int32), np.zeros(len(ofs), np.int64), np.ones(len(ofs) - 1, bool)
        kind, width = (pa.StringArray, np.int32) if at[-1] < 1 << 31 else (pa.LargeStringArray, np.int64)
        words = kind.from_buffers(len(at) - 1, pa.py_buffer(at.astype(width)), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        flat, start, n, same = self.of_units(words.dictionary)
        index = words.indices.to_numpy()
        count = n[index]
        ends = np.concatenate([[0], np.cumsum(count)])[rows]
        ids = slices(flat, start[index], count)
        if same.all():
            return ids, ends, np.ones(len(ofs) - 1, bool)
        bad = np.concatenate([[0], np.cumsum(~same[index])])[rows]
        return ids, ends, np.diff(bad) == 0


class ByteBpe(Encoder):
    """Byte-level BPE of the ``tokenizers`` library.

    ``plain`` makes the strings of special tokens ordinary text; otherwise they are found in texts.
    """

    def __init__(self, path: str, plain: bool = False, keep: int = 600_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        from tokenizers import Tokenizer

        self._of = Tokenizer.from_file(path)
        self._of.encode_special_tokens = plain
        # the byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in set(printable)]
        byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(other)}
        special = {i: t.content for i, t in self._of.get_added_tokens_decoder().items()}
        by_id = {i: t for t, i in self._of.get_vocab().items()}
        size = max(by_id) + 1
        told = [special[i].encode() if i in special else bytes(byte[c] for c in by_id.get(i, "")) for i in range(size)]
        super().__init__(told, keep)
        self.lossless = set(byte) <= set(by_id.values())  # special tokens join to their strings as well

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._of.encode_batch_fast(texts, add_special_tokens=False)]

    def library(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        # units side by side are encoded as they are alone, so many go into one call
        data, ofs = T.flat(names)
        size = np.diff(ofs)
        long = size > 1
        follows = long.copy()
        follows[long] = (data[ofs[:-1][long]] == 32) & (data[ofs[1:][long] - 1] != 32) & _SOLID[data[ofs[:-1][long] + 1]]
        order = np.argsort(~follows, kind="stable")
        data, ofs = T.flat(names.take(pa.array(order)))
        m, n = int(follows.sum()), len(names)
        cuts = [*range(0, m, 4096), *range(m, n + 1)] if m else list(range(n + 1))
        texts = [data[ofs[i] : ofs[j]].tobytes().decode("utf-8", "surrogatepass") for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        parts, lens = [], np.zeros(n, np.int64)
        for i, j, ids in zip(cuts[:-1], cuts[1:], self._ids(texts), strict=True):
            flat = np.array(ids, np.int32)
            upto, ends = np.concatenate([[0], np.cumsum(self.lengths[flat])]), ofs[i + 1 : j + 1] - ofs[i]
            cut = np.searchsorted(upto, ends) if j > i + 1 else np.array([len(flat)])
            if j > i + 1 and (upto[-1] != ends[-1] or (upto[cut] != ends).any()):  # should a token cross units after all
                each = self._ids([data[ofs[k] : ofs[k + 1]].tobytes().decode("utf-8", "surrogatepass") for k in range(i, j)])
                flat, cut = np.array([x for y in each for x in y], np.int32), np.cumsum([len(y) for y in each])
            parts.append(flat)
            lens[order[i:j]] = np.diff(np.concatenate([[0], cut]))
        placed = lens[order]
        starts = np.zeros(n, np.int64)
        starts[order] = np.cumsum(placed) - placed
        return slices(np.concatenate(parts or [np.zeros(0, np.int32)]), starts, lens), lens


class PieceBpe(Encoder):
    """A SentencePiece model; units start with the space that the library adds itself."""

    def __init__(self, path: str, keep: int = 600_000) -> None:
        import sentencepiece

        self._of = sentencepiece.SentencePieceProcessor(model_file=path)
        sp, told = self._of, []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            told.append(bytes([int(piece[3:5], 16)]) if sp.is_byte(i) else piece.replace("▁", " ").encode())
        #: Whether a space always starts a piece, unless another one is in front of it.
        self.spaces_cut = not any("▁" in sp.id_to_piece(i).lstrip("▁") for i in range(sp.get_piece_size()))
        super().__init__(told, keep)

    def library(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids = self._of.encode([u[1:] for u in names.to_pylist()], num_threads=1)
        lens = np.array([len(x) for x in ids], np.int64)
        return np.fromiter(chain.from_iterable(ids), np.int32, int(lens.sum())), lens

    def encode(self, data: np.ndarray, ofs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.spaces_cut:
            raise ValueError("this vocabulary has pieces that reach over a space")
        return super().encode(data, ofs)


_LOADED: dict[tuple, Encoder] = {}


def loaded(kind: type[Encoder], *args) -> Encoder:
    """One encoder of a worker process for its kind and arguments."""
    if (kind, args) not in _LOADED:
        _LOADED[kind, args] = kind(*args)
    return _LOADED[kind, args]
