"""Vectorised byte-level text helpers, used inside Arrow batches on executors.

A batch of texts is one flat byte array with offsets (Arrow's own layout), so no Python
string per row is made.  Hashes are polynomial over Z/2^64 with an odd base: prefix sums
give the hash of any byte range in two multiplications, and a finaliser mixes the bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_CACHE: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (rows + 1) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # no chunk at all
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if "string" in str(column.type) else b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ofs, data = column.buffers()
    ofs = np.frombuffer(ofs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[ofs[0] : ofs[-1]]
    return data, ofs - ofs[0]


def slices(ofs: np.ndarray, limit: int = 1 << 20) -> list[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each (a longer single row stands alone)."""
    out, at, n = [], 0, len(ofs) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(ofs, ofs[at] + limit, "right")) - 1)
        out.append((at, min(end, n)))
        at = min(end, n)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Base**i and its inverse for i below ``n``, grown on demand."""
    if not _CACHE or len(_CACHE[0][0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, _BASE, U64), np.full(size, _INV, U64)
        up[0] = down[0] = 1
        _CACHE[0] = (np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64))
    return _CACHE[0][0][:n], _CACHE[0][1][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums S with S[j] - S[i] = hash of data[i:j] times base**i."""
    out = np.zeros(len(data) + 1, U64)
    up, _ = powers(len(data) + 1)
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=out[1:], dtype=U64)
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hash of every data[start:end]; equal bytes give equal hashes wherever they stand."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U64) * U64(0xA24BAED4963EE407))


def word_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of every data[start:end], ranges that don't overlap; for words whose bytes are chosen to collide, too.

    Alone, a polynomial modulo 2^64 gives one value to words that differ in a regular pattern
    of two letters. Here each place of the sum is a mixed value of the byte and the (at most)
    seven before it in its own word, so that no difference repeats along a word.
    """
    near = data.astype(U64) + U64(1)
    place = np.full(len(data), 8, np.int8)
    for k in range(7):
        at = start + k
        place[at[at < end]] = k
    wide = near.copy()
    for k in range(1, 8):
        wide[k:] |= np.where(place[k:] >= k, near[:-k], U64(0)) << U64(8 * k)
    sums = np.zeros(len(data) + 1, U64)
    up, down = powers(len(data) + 1)
    np.cumsum(mix(wide) * up[: len(data)], out=sums[1:], dtype=U64)
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U64) * U64(0xA24BAED4963EE407))


def is_space(data: np.ndarray) -> np.ndarray:
    """Bytes x20 and x09 to x0D."""
    return (data == 32) | ((data >= 9) & (data <= 13))


def words(data: np.ndarray, ofs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and words per row; words never cross rows."""
    n = len(data)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(ofs) - 1, np.int64)
    word = ~is_space(data)
    first = word.copy()
    first[1:] &= ~word[:-1]
    cut = ofs[1:-1]
    cut = cut[cut < n]
    first[cut] = word[cut]
    last = word.copy()
    last[:-1] &= ~word[1:]
    cut = ofs[1:-1]
    cut = cut[cut > 0] - 1
    last[cut] = word[cut]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.diff(np.searchsorted(start, ofs))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
