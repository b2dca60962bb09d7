"""Elias-Fano sequences: monotone integers in a few bits each, with vectorised access and successor search on memory-mapped arrays."""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

import numpy as np

_TYPES = [np.dtype(t) for t in ("<u8", "<u4", "<u2", "u1", "<i8", "<f8")]
_ONE = np.uint64(1)
_SIX = np.uint64(6)
_LAST = np.uint64(63)


def _u(x: int) -> np.uint64:
    return np.uint64(x)


class EliasFano:
    """Non-decreasing values below 2**63.

    The `low` bits of each value are packed; the rest is a unary bit vector: for every high part a one per value and a closing zero. Ones and zeros before each word
    are kept, so both selects are one binary search and six steps in a word.
    """

    def __init__(self, meta: np.ndarray, low: np.ndarray, high: np.ndarray, ones: np.ndarray, zeros: np.ndarray):
        self.n, self.width, self.buckets = int(meta[0]), int(meta[1]), int(meta[2])
        self.meta, self.low, self.high, self.ones, self.zeros = meta, low, high, ones, zeros

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.ascontiguousarray(values, dtype=np.uint64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        width = max(0, (top // max(1, n)).bit_length() - 1)
        parts = (values >> _u(width)).astype(np.int64)
        buckets = int(parts[-1]) + 1 if n else 1
        bits = np.zeros(-(-(n + buckets) // 64) * 64, dtype=np.uint8)
        bits[parts + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little").view("<u8")
        counted = np.cumsum(np.bitwise_count(high), dtype=np.int64)
        ones = np.concatenate([[0], counted[:-1]]).astype(np.uint32)
        zeros = (np.arange(len(high)) * 64 - ones).astype(np.uint32)
        low = np.zeros(n * width // 64 + 2, dtype=np.uint64)
        if width:
            rest = values & _u((1 << width) - 1)
            at = np.arange(n, dtype=np.uint64) * _u(width)
            word, shift = (at >> _SIX).astype(np.int64), at & _LAST
            np.bitwise_or.at(low, word, rest << shift)
            spill = np.flatnonzero(shift + _u(width) > _u(64))
            np.bitwise_or.at(low, word[spill] + 1, rest[spill] >> (_u(64) - shift[spill]))
        return cls(np.array([n, width, buckets], dtype=np.int64), low, high, ones, zeros)

    def arrays(self) -> list[np.ndarray]:
        return [self.meta, self.low, self.high, self.ones, self.zeros]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), dtype=np.uint64)
        at = i.astype(np.uint64) * _u(self.width)
        word, shift = (at >> _SIX).astype(np.int64), at & _LAST
        first = self.low[word] >> shift
        second = self.low[word + 1] << _ONE << (_LAST - shift)  # in two steps: a shift by 64 is undefined
        return (first | second) & _u((1 << self.width) - 1)

    @staticmethod
    def _in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Place of the k-th one (from 0) of each word."""
        place = np.zeros(len(k), dtype=np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            low = word & _u((1 << width) - 1)
            count = np.bitwise_count(low)
            above = k >= count
            word = np.where(above, word >> _u(width), low)
            k = np.where(above, k - count, k)
            place += width * above
        return place

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at places i."""
        i = np.asarray(i, dtype=np.int64)
        if not len(i):
            return np.empty(0, dtype=np.uint64)
        word = np.searchsorted(self.ones, i.astype(np.uint32), side="right") - 1
        place = word * 64 + self._in_word(self.high[word], i - self.ones[word].astype(np.int64))
        return (place - i).astype(np.uint64) << _u(self.width) | self._low(i)

    def _bucket_ends(self, h: np.ndarray) -> np.ndarray:
        """Number of values whose high part is at most h (h from -1)."""
        out = np.zeros(len(h), dtype=np.int64)
        inside = h >= 0
        k = h[inside]
        word = np.searchsorted(self.zeros, k.astype(np.uint32), side="right") - 1
        place = word * 64 + self._in_word(~self.high[word], k - self.zeros[word].astype(np.int64))
        out[inside] = place - k
        return out

    def _bucket(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places at which the values with high parts h begin and end. The ones of a bucket follow its predecessor's zero, mostly in the same word."""
        lo = self._bucket_ends(h - 1)
        bit = lo + h
        rest = ~self.high[bit >> 6] >> (bit & 63).astype(np.uint64)
        hi = lo + np.bitwise_count((rest & (~rest + _ONE)) - _ONE)
        far = np.flatnonzero(rest == 0)
        hi[far] = self._bucket_ends(h[far])
        return lo, hi

    def _search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Which x have a bucket; of these the places of their successors, the ends of their buckets, and their low parts."""
        part = x >> _u(self.width)
        inside = part < _u(self.buckets)
        want = x[inside] & _u((1 << self.width) - 1)
        lo, hi = self._bucket(part[inside].astype(np.int64))
        end = hi.copy()
        active = np.flatnonzero(lo < hi)
        while len(active):
            middle = (lo[active] + hi[active]) >> 1
            less = self._low(middle) < want[active]
            lo[active[less]] = middle[less] + 1
            hi[active[~less]] = middle[~less]
            active = active[lo[active] < hi[active]]
        return inside, lo, end, want

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Place of the first value >= x, n if there is none."""
        x = np.asarray(x, dtype=np.uint64)
        inside, at, _, _ = self._search(x)
        out = np.full(len(x), self.n, dtype=np.int64)
        out[inside] = at
        return out

    def find(self, x: np.ndarray) -> np.ndarray:
        """Place of x, -1 where it does not occur. A successor within the bucket shares the high part, so the low parts decide."""
        x = np.asarray(x, dtype=np.uint64)
        inside, at, end, want = self._search(x)
        same = at < end
        same[same] = self._low(at[same]) == want[same]
        out = np.full(len(x), -1, dtype=np.int64)
        out[inside] = np.where(same, at, -1)
        return out


def save(path: str, arrays: Sequence[np.ndarray]) -> None:
    """Writes arrays one after the other, each on an 8-byte border; a repeated or lost writer leaves either nothing or the same file."""
    head = [len(arrays)]
    for a in arrays:
        head += [_TYPES.index(a.dtype), len(a)]
    draft = f"{path}.{uuid.uuid4().hex}"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(draft, "wb") as out:
        out.write(np.array(head, dtype="<i8").tobytes())
        for a in arrays:
            out.write(a.tobytes())
            out.write(b"\0" * (-a.nbytes % 8))
    os.replace(draft, path)


def load(path: str) -> list[np.ndarray]:
    """Memory-mapped arrays of a file that `save` wrote."""
    raw = np.memmap(path, dtype=np.uint8, mode="r")
    count = int(raw[:8].view("<i8")[0])
    head = raw[8:8 + 16 * count].view("<i8")
    at, out = 8 + 16 * count, []
    for kind, length in zip(head[::2].tolist(), head[1::2].tolist()):
        size = _TYPES[kind].itemsize * length
        out.append(raw[at:at + size].view(_TYPES[kind]))
        at += -(-size // 8) * 8
    return out
