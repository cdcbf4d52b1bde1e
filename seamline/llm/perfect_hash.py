"""Minimal perfect hashing of distinct 64-bit keys.

Level by level, keys that share their place with no other key of the level are settled
there by a bit; the others go on to the next level.  The number of bits set before a
key's own numbers the keys from 0 without gaps.  A key that was not among those hashed
may get a number as well, so that a table by these numbers must keep its keys.
"""

from __future__ import annotations

import numpy as np

from seamline.llm.textbuf import mix

_U = np.uint64
ROOM = 2  # places for each key of a level


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    seed = _U((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    return (mix(keys + seed) % _U(size)).astype(np.int64)


class PerfectHash:
    """Numbers of a set of distinct keys, from its bits."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self._starts = np.cumsum(sizes) - sizes
        self._numbers = np.cumsum(bits, dtype=np.int64) - 1

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        rest, sizes, levels = keys, [], []
        while len(rest):
            size = -(-len(rest) * ROOM // 8) * 8
            place = _place(rest, len(sizes), size)
            alone = np.bincount(place, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            rest = rest[~alone[place]]
        return cls(np.array(sizes, np.int64), np.concatenate([np.zeros(0, bool), *levels]))

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; -1 for some keys that were not hashed."""
        found = np.full(len(keys), -1, np.int64)
        rest = np.arange(len(keys))
        for level, (start, size) in enumerate(zip(self._starts, self.sizes)):
            place = start + _place(keys[rest], level, int(size))
            here = self.bits[place]
            found[rest[here]] = self._numbers[place[here]]
            rest = rest[~here]
            if not len(rest):
                break
        return found

    def to_bytes(self) -> bytes:
        return np.array([len(self.sizes), *self.sizes], "<i8").tobytes() + np.packbits(self.bits).tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        levels = int(np.frombuffer(data, "<i8", 1)[0])
        sizes = np.frombuffer(data, "<i8", levels, 8)
        bits = np.unpackbits(np.frombuffer(data, np.uint8, offset=8 + 8 * levels), count=int(sizes.sum()))
        return cls(sizes, bits.astype(bool))
