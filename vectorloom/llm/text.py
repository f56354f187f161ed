"""Vectorised word and shingle hashing over Arrow string columns.

Words are maximal runs of bytes other than space and 0x09-0x0D, with ASCII A-Z lower-cased.
Work runs over blocks of about ``BLOCK`` bytes cut at separators, so that temporary arrays
stay small whatever the length of a text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BLOCK = 1 << 16

_U = np.uint64
_NINE = np.uint8(9)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
#: Random odd 64-bit multiplier of the rolling polynomial.
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection on 64 bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x = x * _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


#: A random 64-bit value of each byte; separators count as nothing.
_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD1342543DE82EF95))
_VALUE = _VALUE[_LOWER]
_VALUE[_SEP] = 0


def _powers(n: int, base: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    have = 1
    step = base
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * _U(step)
        step = step * step % (1 << 64)
        have += more
    return out


_tables: dict[str, np.ndarray] = {}


def _tables_for(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _tables or len(_tables["up"]) < n:
        size = max(n, BLOCK + 4096)
        _tables["up"] = _powers(size, _BASE)
        _tables["down"] = _powers(size, pow(_BASE, -1, 1 << 64))
    return _tables["up"], _tables["down"]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of each row) of a string or binary array; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    big = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if big else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.empty(0, np.uint8)
    return raw, at - at[0]


def _cut(raw: np.ndarray, lo: int) -> int:
    """Where the block that begins at lo ends: at a separator, or with the bytes."""
    end = min(lo + BLOCK, len(raw))
    while end < len(raw) and not _SEP[raw[end]]:
        hit = np.flatnonzero(_SEP[raw[end : end + BLOCK]])
        end = end + int(hit[0]) if len(hit) else min(end + BLOCK, len(raw))
    return end


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, first word of each row, byte start, byte end of each word)."""
    raw, at = buffers(column)
    return word_hashes_of(raw, at)


def word_hashes_of(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = len(raw)
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    lo = 0
    while lo < n:
        hi = _cut(raw, lo)
        block = raw[lo:hi]
        sep = (block == 32) | ((block - _NINE) < 5)
        edge = np.ones(hi - lo + 1, dtype=bool)  # a word may begin here
        edge[1:] = False
        a, b = np.searchsorted(at, (lo, hi))
        edge[at[a:b] - lo] = True
        edge[-1] = True
        edge[1:-1] |= sep[:-1]
        word = ~sep
        starts = np.flatnonzero(word & edge[:-1])
        edge[1:-1] |= sep[1:]
        ends = np.flatnonzero(word & edge[1:]) + 1
        if len(starts):
            up, down = _tables_for(hi - lo)
            value = np.take(_VALUE, block, mode="clip")
            value *= up[: hi - lo]
            total = np.cumsum(value)
            sums = (total[ends - 1] - total[starts] + value[starts]) * down[starts]
            sums ^= (ends - starts).astype(np.uint64) * _U(0xA24BAED4963EE407)
            parts.append((mix(sums), starts + lo, ends + lo))
        lo = hi
    if not parts:
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), np.zeros(len(at), np.int64), none, none
    words, starts, ends = (np.concatenate(x) for x in zip(*parts, strict=True))
    return words, np.searchsorted(starts, at), starts, ends


def shingle_weights(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _U(0x9FB21C651E98DF25)) | _U(1)


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word shingles of one text: with fewer words the whole sequence is one."""
    k = len(words)
    if k == 0:
        return words
    w = shingle_weights(n)
    if k < n:
        total = (words * w[:k]).sum(keepdims=True)
        return mix(total ^ np.full(1, k, np.uint64) * _U(0xC2B2AE3D27D4EB4F))
    total = words[: k - n + 1] * w[0]
    for j in range(1, n):
        total = total + words[j : k - n + 1 + j] * w[j]
    return mix(total)


def all_shingles(words: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes of all rows one after another, first shingle of each row)."""
    counts = np.diff(bounds)
    if len(words) == 0:
        return words, np.zeros(len(bounds), np.int64)
    w = shingle_weights(n)
    total = np.zeros(max(0, len(words) - n + 1), dtype=np.uint64)
    for j in range(n):
        total += words[j : len(total) + j] * w[j]
    total = mix(total)
    made = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    first = np.zeros(len(bounds), np.int64)
    np.cumsum(made, out=first[1:])
    out = np.empty(first[-1], dtype=np.uint64)
    full = counts >= n
    # positions of full rows: word position minus (n - 1) for every row before
    pos = np.ones(len(words), dtype=bool)
    ends = bounds[1:]
    for j in range(1, n):
        tail = ends[counts >= j] - j
        pos[tail] = False
    keep = np.flatnonzero(pos)  # starts of whole shingles
    slot = np.ones(first[-1], dtype=bool)
    short = np.flatnonzero(~full & (counts > 0))
    slot[first[short]] = False
    out[slot] = total[keep]
    for r in short:
        out[first[r]] = shingles(words[bounds[r] : bounds[r + 1]], n)[0]
    return out, first
