"""Elias-Fano coded monotone sequences, with vectorised access and successor search, and array files."""

from __future__ import annotations

import json
import os
import tempfile
import uuid

import numpy as np
from pyarrow import fs

_U = np.uint64
_SAMPLE = 64


class EliasFano:
    """n non-decreasing values below universe in about 2 + log2(universe / n) bits each.

    The low bits stand packed; the high parts are counted in unary, a zero ending each bucket.
    Positions of every 64th one and zero are kept, so that both selects look at a few words.
    """

    def __init__(self, arrays: dict[str, np.ndarray], prefix: str = ""):
        n, self.l, self.buckets = (int(x) for x in arrays[f"{prefix}head"])
        self.n = n
        self.low, self.high = arrays[f"{prefix}low"], arrays[f"{prefix}high"]
        self.ones, self.zeros = arrays[f"{prefix}ones"], arrays[f"{prefix}zeros"]

    @staticmethod
    def build(values: np.ndarray, universe: int, prefix: str = "") -> dict[str, np.ndarray]:
        n = len(values)
        values = values.astype(np.uint64)
        low_bits = max(0, (max(1, universe) // max(1, n)).bit_length() - 1)
        high = (values >> _U(low_bits)).astype(np.int64)
        buckets = (max(1, universe) - 1 >> low_bits) + 1
        ones_at = high + np.arange(n, dtype=np.int64)
        size = n + buckets
        bits = np.zeros(-(-size // 64) * 64 + 64, dtype=np.uint8)
        bits[ones_at] = 1
        words = np.packbits(bits, bitorder="little").view("<u8")
        zeros_at = np.flatnonzero(bits[:size] == 0)
        packed = np.zeros((n * low_bits + 63) // 64 + 2, dtype=np.uint64)
        if low_bits and n:
            part = values & _U((1 << low_bits) - 1)
            at = np.arange(n, dtype=np.uint64) * _U(low_bits)
            word, off = (at >> _U(6)).astype(np.int64), at & _U(63)
            np.bitwise_or.at(packed, word, part << off)
            over = off + _U(low_bits) > _U(64)
            np.bitwise_or.at(packed, word[over] + 1, part[over] >> (_U(64) - off[over]))
        return {
            f"{prefix}head": np.array([n, low_bits, buckets], dtype=np.int64), f"{prefix}low": packed, f"{prefix}high": words,
            f"{prefix}ones": ones_at[::_SAMPLE].astype(np.int64), f"{prefix}zeros": zeros_at[::_SAMPLE].astype(np.int64),
        }

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """Bit position of the k-th one or zero."""
        at = (self.ones if ones else self.zeros)[k // _SAMPLE]
        left = (k % _SAMPLE).astype(np.int64)
        word = at >> 6
        mask = ~_U(0) << (at & 63).astype(np.uint64)
        flip = _U(0) if ones else ~_U(0)
        value = (self.high[word] ^ flip) & mask
        count = np.bitwise_count(value).astype(np.int64)
        todo = np.flatnonzero(left >= count)
        while len(todo):
            left[todo] -= count[todo]
            word[todo] += 1
            value[todo] = self.high[word[todo]] ^ flip
            count[todo] = np.bitwise_count(value[todo])
            todo = todo[left[todo] >= count[todo]]
        return word * 64 + _in_word(value, left)

    def _next(self, at: np.ndarray, k: np.ndarray, ones: bool) -> np.ndarray:
        """Bit position of the k-th one or zero, which is the first at or after a position."""
        word, off = at >> 6, (at & 63).astype(np.uint64)
        value = (self.high[word] if ones else ~self.high[word]) >> off
        out = at + np.bitwise_count((value & (~value + _U(1))) - _U(1)).astype(np.int64)
        far = np.flatnonzero(value == 0)
        if len(far):
            out[far] = self._select(k[far], ones)
        return out

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.l:
            return np.zeros(len(i), dtype=np.uint64)
        at = i.astype(np.uint64) * _U(self.l)
        word, off = (at >> _U(6)).astype(np.int64), at & _U(63)
        value = self.low[word] >> off
        more = off + _U(self.l) > _U(64)
        value[more] |= self.low[word[more] + 1] << (_U(64) - off[more])
        return value & _U((1 << self.l) - 1)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, dtype=np.int64)
        return ((self._select(i, True) - i).astype(np.uint64) << _U(self.l)) | self._lows(i)

    def pair(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values i and i + 1."""
        at = self._select(i, True)
        after = self._next(at + 1, i + 1, True)
        low = lambda p, k: ((p - k).astype(np.uint64) << _U(self.l)) | self._lows(k)
        return low(at, i), low(after, i + 1)

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first value that is at least x, n if there is none; whether it equals x)."""
        x = np.asarray(x, dtype=np.uint64)
        h = (x >> _U(self.l)).astype(np.int64)
        inside = np.flatnonzero(h < self.buckets)
        out = np.full(len(x), self.n, dtype=np.int64)
        same = np.zeros(len(x), dtype=bool)
        h = h[inside]
        # the bucket's ones stand between two zeros
        begin = np.zeros(len(h), dtype=np.int64)
        later = np.flatnonzero(h > 0)
        begin[later] = self._select(h[later] - 1, False) + 1
        lo = begin - h
        last = self._next(begin, h, False) - h
        hi = last.copy()
        want = x[inside] & _U((1 << self.l) - 1)
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            less = self._lows(mid) < want[live]
            lo[live[less]] = mid[less] + 1
            hi[live[~less]] = mid[~less]
            live = live[lo[live] < hi[live]]
        out[inside] = lo
        here = np.flatnonzero(lo < last)
        same[inside[here]] = self._lows(lo[here]) == want[here]
        return out, same

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Index of the first value that is at least x; n if there is none."""
        return self.find(x)[0]


_L8, _H8 = _U(0x0101010101010101), _U(0x8080808080808080)
#: Place of the k-th set bit of a byte, at [k * 256 + byte].
_PLACES = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[k] for k in range(8) for b in range(256)], dtype=np.int64)


def _in_word(v: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th set bit of each word: sums of bits by byte find the byte, a table the bit."""
    s = v - ((v >> _U(1)) & _U(0x5555555555555555))
    s = (s & _U(0x3333333333333333)) + ((s >> _U(2)) & _U(0x3333333333333333))
    s = ((s + (s >> _U(4))) & _U(0x0F0F0F0F0F0F0F0F)) * _L8
    rank = k.astype(np.uint64)
    byte = np.bitwise_count(((rank * _L8 | _H8) - s) & _H8).astype(np.uint64) << _U(3)
    left = rank - (((s << _U(8)) >> byte) & _U(255))
    return byte.astype(np.int64) + _PLACES[((left << _U(8)) | ((v >> byte) & _U(255))).astype(np.int64)]


def _resolve(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")


def write_arrays(path: str, arrays: dict[str, np.ndarray]) -> None:
    """Writes arrays as one file under a temporary name, then moves it into place: a retried task repeats safely."""
    where, inner = _resolve(path)
    where.create_dir(os.path.dirname(inner), recursive=True)
    head, at, order = {}, 0, list(arrays)
    for name in order:
        a = np.ascontiguousarray(arrays[name])
        head[name] = (a.dtype.str, a.shape[0], at)
        at += -(-a.nbytes // 64) * 64
    text = json.dumps(head).encode()
    text = text.ljust(-(-(len(text) + 8) // 64) * 64 - 8)
    part = f"{inner}.{uuid.uuid4().hex}"
    with where.open_output_stream(part) as f:
        f.write(len(text).to_bytes(8, "little") + text)
        for name in order:
            raw = np.ascontiguousarray(arrays[name]).tobytes()
            f.write(raw)
            f.write(b"\0" * (-len(raw) % 64))
    where.move(part, inner)


def drop_file(path: str) -> None:
    """Deletes a file; what is mapped of it stays until it is let go."""
    where, inner = _resolve(path)
    where.delete_file(inner)


def map_arrays(path: str) -> dict[str, np.ndarray]:
    """Memory-maps the arrays of a file: in place in a mounted folder, else through a copy that is unlinked at once."""
    where, inner = _resolve(path)
    local = inner
    if not isinstance(where, fs.LocalFileSystem):
        local = os.path.join(tempfile.gettempdir(), f"arrays-{uuid.uuid4().hex}")
        fs.copy_files(inner, local, source_filesystem=where, destination_filesystem=fs.LocalFileSystem())
    with open(local, "rb") as f:
        size = int.from_bytes(f.read(8), "little")
        head = json.loads(f.read(size))
    out = {}
    whole = np.asarray(np.memmap(local, "u1", "r"))
    for name, (kind, n, at) in head.items():
        start = 8 + size + at
        out[name] = whole[start : start + n * np.dtype(kind).itemsize].view(kind)
    if local != inner:
        os.unlink(local)
    return out
