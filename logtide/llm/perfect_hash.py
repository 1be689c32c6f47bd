"""A minimal perfect hash of 64-bit keys: n distinct keys to the numbers 0 to n - 1.

Each level is a row of bits, twice as many as keys are left. A key alone at its
bit stays there; keys that share one go on to the next level. The number of a
key is the count of bits set before its own. A lookup takes constant time and a
key about four bits.
"""

from __future__ import annotations

import numpy as np

#: Bits of a level per key left, and levels before the few last keys are listed.
SPACE = 2
LEVELS = 40

_WORD = 64


def mixed(values: np.ndarray, salt: int) -> np.ndarray:
    """A one-to-one scramble of 64-bit integers, another for each salt."""
    with np.errstate(over="ignore"):
        x = values.astype(np.uint64) + np.uint64((salt + 1) * 0x9E3779B97F4A7C15 % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    def __init__(self, levels: list[np.ndarray], listed: np.ndarray):
        self.levels = levels  # of 64-bit words
        self.listed = listed  # sorted keys no level placed
        self.ranks, held = [], 0
        for words in levels:
            counts = np.bitwise_count(words).astype(np.int64)
            self.ranks.append(held + np.cumsum(counts) - counts)
            held += int(counts.sum())
        self.held = held

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, levels = keys.astype(np.uint64), []
        while len(left) and len(levels) < LEVELS:
            words = -(-SPACE * len(left) // _WORD)
            at = (mixed(left, len(levels)) % np.uint64(words * _WORD)).astype(np.int64)
            alone = np.bincount(at, minlength=words * _WORD) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[at]]
        return cls(levels, np.sort(left))

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; of one that was not built in, any number or -1."""
        keys = keys.astype(np.uint64)
        found = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, words in enumerate(self.levels):
            at = mixed(keys[open_], level) % np.uint64(len(words) * _WORD)
            word, bit = (at // _WORD).astype(np.int64), at % np.uint64(_WORD)
            own = words[word]
            here = (own >> bit) & np.uint64(1) == 1
            before = own & ((np.uint64(1) << bit) - np.uint64(1))
            rank = self.ranks[level][word] + np.bitwise_count(before)
            found[open_[here]] = rank[here]
            open_ = open_[~here]
        if len(self.listed):
            place = np.minimum(np.searchsorted(self.listed, keys[open_]), len(self.listed) - 1)
            here = self.listed[place] == keys[open_]
            found[open_[here]] = self.held + place[here]
        return found

    def to_bytes(self) -> bytes:
        sizes = [len(self.levels), len(self.listed), *map(len, self.levels)]
        parts = [np.array(sizes, "<u8"), *self.levels, self.listed]
        return b"".join(part.astype("<u8").tobytes() for part in parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        words = np.frombuffer(data, "<u8")
        n, listed = int(words[0]), int(words[1])
        at, levels = 2 + n, []
        for size in words[2 : 2 + n].astype(np.int64):
            levels.append(words[at : at + size])
            at += size
        return cls(levels, words[at : at + listed])
