"""Minimal perfect hashing of 64-bit keys by levels of collision-free bit arrays.

Keys that are alone in their slot of a level are placed there, the others go to the next
level; a key's index is the rank of its bit.  Building and probing work on whole arrays.
"""

from __future__ import annotations

import struct

import numpy as np

from fieldloom.llm.common import mix

_LEVELS = 60


def _slots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Index 0..n-1 of each of n distinct keys; -1 or any index for other keys, so callers keep fingerprints."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes = sizes
        self.bits = bits
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        # ranks by 64 bits; the rest of a rank is a popcount of one word
        packed = np.packbits(bits, bitorder="little")
        self.words = np.frombuffer(np.pad(packed, (0, -len(packed) % 8)).tobytes(), np.uint64)
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))]).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 1.7) -> "PerfectHash":
        keys = np.unique(keys.astype(np.uint64))
        sizes, bits = [], []
        for level in range(_LEVELS):
            if not len(keys):
                break
            size = max(8, int(gamma * len(keys)))
            slots = _slots(keys, level, size)
            alone = np.bincount(slots, minlength=size) == 1
            sizes.append(size)
            bits.append(alone)
            keys = keys[~alone[slots]]
        if len(keys):
            raise ValueError("keys can't be told apart")
        return cls(sizes, np.concatenate(bits) if bits else np.zeros(0, bool))

    def index(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.astype(np.uint64)
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = _slots(keys[left], level, size) + self.starts[level]
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            below = word & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[hit]] = self.ranks[at[hit] >> 6] + np.bitwise_count(below[hit])
            left = left[~hit]
        return out

    def to_bytes(self) -> bytes:
        return struct.pack(f"<I{len(self.sizes)}Q", len(self.sizes), *self.sizes) + np.packbits(self.bits, bitorder="little").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> "PerfectHash":
        (n,) = struct.unpack_from("<I", raw)
        sizes = list(struct.unpack_from(f"<{n}Q", raw, 4))
        bits = np.unpackbits(np.frombuffer(raw, np.uint8, offset=4 + 8 * n), bitorder="little", count=sum(sizes)).astype(bool)
        return cls(sizes, bits)
