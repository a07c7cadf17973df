"""Elias-Fano codes of non-decreasing integers, with a select structure.

n values below u take about 2 + log2(u / n) bits each.  Value i is read from
its low bits and the place of the i-th one in the high bits; every
SELECT-th one's place is kept, so a read looks at a bounded stretch.
"""

from __future__ import annotations

import struct

import numpy as np

from .common import by_value

by_value(__name__)

SELECT = 256
_HEAD = "<QQBQ"  # count, first value, low bits, bytes of high bits


class EliasFano:
    def __init__(self, n: int, base: int, low_bits: int, low: np.ndarray, high: np.ndarray, marks: np.ndarray):
        self.n, self.base, self.low_bits, self.low, self.high, self.marks = n, base, low_bits, low, high, marks

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        if not len(v):
            return cls(0, 0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.uint32))
        base = int(v[0])
        v = v - v[0]
        n, top = len(v), int(v[-1])
        low_bits = max(0, ((top + 1) // n).bit_length() - 1)
        low = np.zeros(0, np.uint8)
        if low_bits:
            bits = (v[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
            low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        ones = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) // 8 + 1, np.uint8)
        np.bitwise_or.at(high, ones >> 3, (1 << (ones & 7)).astype(np.uint8))
        return cls(n, base, low_bits, low, high, ones[::SELECT].astype(np.uint32))

    def dumps(self) -> bytes:
        return struct.pack(_HEAD, self.n, self.base, self.low_bits, len(self.high)) + self.marks.tobytes() + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def loads(cls, data: bytes, at: int = 0) -> tuple[EliasFano, int]:
        n, base, low_bits, high = struct.unpack_from(_HEAD, data, at)
        at += struct.calcsize(_HEAD)
        parts = []
        for kind, count in ((np.uint32, -(-n // SELECT)), (np.uint8, (n * low_bits + 7) // 8), (np.uint8, high)):
            parts.append(np.frombuffer(data, kind, count, at))
            at += parts[-1].nbytes
        return cls(n, base, low_bits, parts[1], parts[2], parts[0]), at

    def select(self, i: int) -> int:
        """Place of the i-th one in the high bits."""
        place = int(self.marks[i // SELECT])
        left = i % SELECT
        byte = place >> 3
        skip = (1 << (place & 7)) - 1  # ones before the mark in its byte
        while True:
            stretch = self.high[byte : byte + 64].copy()
            stretch[0] &= 255 ^ skip
            counts = np.cumsum(np.bitwise_count(stretch), dtype=np.int64)
            if counts[-1] > left:
                k = int(np.searchsorted(counts, left, "right"))
                within = left - (int(counts[k - 1]) if k else 0)
                return (byte + k) * 8 + int(np.flatnonzero(np.unpackbits(stretch[k : k + 1], bitorder="little"))[within])
            left -= int(counts[-1])
            byte, skip = byte + 64, 0

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = self.select(i) - i
        at = i * self.low_bits
        if self.low_bits:
            some = self.low[at >> 3 : (at + self.low_bits + 7) >> 3]
            value = value << self.low_bits | (int.from_bytes(some.tobytes(), "little") >> (at & 7)) & ((1 << self.low_bits) - 1)
        return value + self.base

    def some(self, i: int, j: int) -> np.ndarray:
        """Values i to j - 1, from the high bits between two selects."""
        if i >= j:
            return np.zeros(0, np.uint64)
        first, last = self.select(i), self.select(j - 1)
        byte = first >> 3
        bits = np.unpackbits(self.high[byte : (last >> 3) + 1], bitorder="little")[first - 8 * byte : last - 8 * byte + 1]
        out = (np.flatnonzero(bits) + first - np.arange(i, j)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            at = i * self.low_bits
            low = np.unpackbits(self.low[at >> 3 : (j * self.low_bits + 7) >> 3], bitorder="little")[at & 7 :][: (j - i) * self.low_bits]
            out |= low.reshape(j - i, self.low_bits).astype(np.uint64) @ (np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64))
        return out + np.uint64(self.base)

    def __len__(self) -> int:
        return self.n

    def all(self) -> np.ndarray:
        """Every value, in one pass."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            bits = np.unpackbits(self.low, bitorder="little", count=self.n * self.low_bits).reshape(self.n, self.low_bits)
            out |= bits.astype(np.uint64) @ (np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64))
        return out + np.uint64(self.base)
