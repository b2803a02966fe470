"""Bloom filters of a fixed size, over 64-bit hashes, that tasks fill and that are merged without a driver-side loop."""

from __future__ import annotations

import numpy as np

#: Bits that a key sets.
PROBES = 4


def bits_for(keys: int, most_bytes: int) -> int:
    """A power of two with about ten bits a key, and at most most_bytes."""
    bits = 1 << max(16, int(np.ceil(np.log2(max(1, keys) * 10))))
    return min(bits, 1 << int(np.floor(np.log2(most_bytes * 8))))


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """PROBES rows of bit numbers."""
    a = hashes & np.uint64(0xFFFFFFFF)
    b = (hashes >> np.uint64(32)) | np.uint64(1)
    return np.stack([(a + np.uint64(i) * b + np.uint64(i * i * i)) & np.uint64(bits - 1) for i in range(PROBES)])


class Pair:
    """Two filters: keys met at least once, and keys met at least twice. Met: added by different calls, or by
    one call with a key that stands in it twice."""

    def __init__(self, bits: int):
        self.bits = bits
        self.once = np.zeros(bits // 8, np.uint8)
        self.twice = np.zeros(bits // 8, np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        unique, counts = np.unique(hashes, return_counts=True)
        at = positions(unique, self.bits)
        again = (counts > 1) | has(self.once, at)
        for bit in at:
            put(self.once, bit)
            put(self.twice, bit[again])


def put(filter_: np.ndarray, bit: np.ndarray) -> None:
    np.bitwise_or.at(filter_, (bit >> np.uint64(3)).astype(np.int64), np.uint8(1) << (bit & np.uint64(7)).astype(np.uint8))


def has(filter_: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.ones(at.shape[1], bool)
    for bit in at:
        out &= (filter_[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out


def merge(once: np.ndarray, twice: np.ndarray, more_once: np.ndarray, more_twice: np.ndarray) -> None:
    """Into once and twice: a key in the first filter of both has been met twice."""
    twice |= more_twice | (once & more_once)
    once |= more_once
