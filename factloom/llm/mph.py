"""A minimal perfect hash with stored keys: levels of bit arrays, slots by rank, numpy throughout.

At each level every key that is left picks one of 2 bits a key; bits picked once stay
set, and the keys that collided go to the next level (Limasset et al., 2017). A key's
slot is the number of set bits before its own. What is left after the last level is looked up in order.
Both halves of the key stand at its slot, so a lookup of any other key gives -1.
"""

from __future__ import annotations

import numpy as np

from .common import mixed

LEVELS = 24


class PerfectHash:
    """Slots 0..n-1 of n distinct keys (first, second), two 64-bit numbers each."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        n = len(first)
        self.bits: list[np.ndarray] = []
        self.ranks: list[np.ndarray] = []
        left, before = np.arange(n), 0
        slot = np.zeros(n, np.int64)
        for level in range(LEVELS):
            if not len(left):
                break
            size = max(64, 2 * len(left))
            at = self._at(first[left], second[left], level, size)
            alone = np.bincount(at, minlength=size) == 1
            rank = np.concatenate([[0], np.cumsum(alone)])
            self.bits.append(alone)
            self.ranks.append((before + rank).astype(np.int32))
            done = alone[at]
            slot[left[done]] = before + rank[at[done]]
            before += int(rank[-1])
            left = left[~done]
        order = left[np.lexsort((second[left], first[left]))]
        slot[order] = before + np.arange(len(order))
        self.rest, self.rest_at = first[order], before
        self.first, self.second = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        self.first[slot], self.second[slot] = first, second

    def __len__(self) -> int:
        return len(self.first)

    @staticmethod
    def _at(first: np.ndarray, second: np.ndarray, level: int, size: int) -> np.ndarray:
        h = mixed(first + second * np.uint64(2 * level + 1) + np.uint64(level))
        return ((h >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)

    def slots(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 of one that isn't stored."""
        out = np.full(len(first), -1, np.int64)
        left = np.arange(len(first))
        for level, (bits, ranks) in enumerate(zip(self.bits, self.ranks, strict=True)):
            if not len(left):
                break
            at = self._at(first[left], second[left], level, len(bits))
            hit = bits[at]
            out[left[hit]] = ranks[at[hit]]
            left = left[~hit]
        if len(left) and len(self.rest):
            # Equal first halves stand together; each is tried.
            low, high = np.searchsorted(self.rest, first[left]), np.searchsorted(self.rest, first[left], "right")
            for k in range(int((high - low).max(initial=0))):
                ok = low + k < high
                at = self.rest_at + low[ok] + k
                same = self.second[at] == second[left[ok]]
                out[left[ok][same]] = at[same]
        known = np.flatnonzero(out >= 0)
        wrong = (self.first[out[known]] != first[known]) | (self.second[out[known]] != second[known])
        out[known[wrong]] = -1
        return out
