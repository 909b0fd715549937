"""Shard Burrows-Wheeler transforms of many strings and their merge by interleave refinement.

A shard's transform lists, in the order of its sorted (cyclic, terminated) suffixes, the
``m`` symbols in front of each suffix. Merging doesn't sort the suffixes of all shards
again: it keeps the interleave of the shards' own orders (one number per suffix) and refines it.
When it is right for the first h symbols, one stable counting sort by the symbols in front
makes it right for h + m. Blocks of equal prefixes are carried along, so after ``length``
symbols each block is a repeated interval: the suffixes whose longest common prefix is at
least ``length``. A suffix that is alone in its block leaves the interleave: it stays alone.
"""

from __future__ import annotations

import numpy as np


def _layout(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols (byte + 1, 0 ends a string), start of each string, and the cyclic predecessor of each position."""
    size = np.array([len(s) + 1 for s in strings], np.int64)
    start = np.concatenate([[0], np.cumsum(size)])
    symbols = np.zeros(start[-1], np.uint16)
    body = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
    symbols[:] = body
    symbols += 1
    symbols[start[1:] - 1] = 0
    before = np.arange(-1, start[-1] - 1)
    before[start[:-1]] = start[1:] - 1
    return symbols, start, before


def _front_codes(symbols: np.ndarray, before: np.ndarray, m: int) -> np.ndarray:
    """Dense ranks of the m symbols in front of each position, as 16 bits if they fit, else None."""
    code, at = np.zeros(len(symbols), np.uint64), before
    for k in range(m):
        code |= symbols[at].astype(np.uint64) << np.uint64(9 * k)
        at = before[at]
    found, rank = np.unique(code, return_inverse=True)
    return rank.astype(np.uint16) if len(found) <= 1 << 16 else None


def sort_shard(symbols: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Order of a shard's cyclic suffixes, by doubling from seven symbols on; ties (equal strings) in string order."""
    n = len(symbols)
    size = np.diff(start)
    owner = np.repeat(np.arange(len(size)), size)
    local = np.arange(n) - start[owner]
    base, width = start[owner], size[owner]
    after = np.arange(1, n + 1)
    after[start[1:] - 1] = start[:-1]
    key, at = np.zeros(n, np.int64), np.arange(n)
    for _ in range(7):  # nine bits a symbol
        key = key << 9 | symbols[at]
        at = after[at]
    step = 7
    while True:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        ranks = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        if ranks[-1] == n - 1 or step > 2 * size.max():
            return order
        rank = np.empty(n, np.int64)
        rank[order] = ranks
        ahead = local + step
        ahead = base + np.where(ahead < width, ahead, ahead % width)
        key, step = rank * (ranks[-1] + 1) + rank[ahead], step * 2


def repeated_starts(strings: list[bytes], length: int, shard_bytes: int = 1 << 18) -> list[np.ndarray]:
    """For each string the offsets whose next ``length`` bytes also start elsewhere, in it or another string."""
    if not strings:
        return []
    symbols, start, before = _layout(strings)
    codes, m = None, 4
    while codes is None:
        m = m // 2 if length % m else m
        codes = _front_codes(symbols, before, m)
        m = m if codes is not None else m // 2
    # shards: whole strings, a bounded number of symbols each, 255 shards at most
    room = max(shard_bytes, -(-len(symbols) // 200))
    cut = [0]
    for i in range(1, len(strings)):
        if start[i] - start[cut[-1]] >= room:
            cut.append(i)
    cut.append(len(strings))
    suffixes = []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        lo, hi = start[a], start[b]
        suffixes.append(lo + sort_shard(symbols[lo:hi], start[a : b + 1] - lo))
    suffix = np.concatenate(suffixes)  # sorted within each shard, shard after shard
    front = codes[suffix]  # the shards' transforms
    # rank, within its own shard's part, of the suffix that begins m symbols earlier
    rank, back = np.empty(len(suffix), np.int32), suffix
    rank[suffix] = np.arange(len(suffix), dtype=np.int32)
    for _ in range(m):
        back = before[back]
    step = rank[back]
    ranks = np.arange(len(suffix), dtype=np.int32)  # the interleave: shard after shard to begin with
    block = np.zeros(len(ranks), np.int32)
    for turn in range(length // m):
        symbol = front[ranks]
        order = np.argsort(symbol, kind="stable")
        symbol, block, ranks = symbol[order], block[order], step[ranks][order]
        edge = np.ones(len(ranks) + 1, bool)
        edge[1:-1] = (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])
        block = np.cumsum(edge[:-1], dtype=np.int32)
        if turn % 4 == 3:  # a suffix alone in its block stays alone when it grows to the left
            shared = ~(edge[:-1] & edge[1:])
            ranks, block = ranks[shared], block[shared]
        if not len(ranks):
            return [np.zeros(0, np.int64)] * len(strings)
    place = suffix[ranks].astype(np.int64)  # text position of each merged suffix
    owner = np.searchsorted(start, place, "right") - 1
    offset = place - start[owner]
    valid = offset + length < start[owner + 1] - start[owner]
    count = np.bincount(block[valid], minlength=int(block.max()) + 1)
    hit = valid & (count[block] > 1)
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(strings)
    at = np.argsort(owner[hit], kind="stable")
    own, ofs = owner[hit][at], offset[hit][at]
    for i, part in zip(np.unique(own), np.split(ofs, np.flatnonzero(np.diff(own)) + 1), strict=False):
        out[i] = np.sort(part)
    return out
