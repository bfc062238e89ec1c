"""A cuckoo filter over 64-bit hashes in numpy: 4 slots a bucket, 16-bit fingerprints, deletions.

``bulk`` places what it can bucket by bucket and kicks the rest one by one, so a
shard of a million keys is filled in about a second. The table doubles when a
chain of kicks does not end, by being built anew from the caller's keys: add()
returns False then and leaves the filter as it was but for the swapped slots.
"""

from __future__ import annotations

import numpy as np

SLOTS, KICKS, LOAD = 4, 500, 0.85
_M = np.uint64(0x9E3779B97F4A7C15)


class CuckooFilter:
    def __init__(self, buckets: int):
        self.buckets = max(1, buckets)
        assert self.buckets & (self.buckets - 1) == 0
        self.table = np.zeros((self.buckets, SLOTS), np.uint16)

    @classmethod
    def sized(cls, n: int) -> CuckooFilter:
        return cls(1 << max(0, int(np.ceil(np.log2(max(1.0, n / (SLOTS * LOAD)))))))

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        """A filter that holds all keys, in which a key may stand up to 2 * SLOTS times."""
        out = cls.sized(len(keys))
        while not out.bulk(keys):
            out = cls(out.buckets * 2)
        return out

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys = np.asarray(keys).astype(np.int64).view(np.uint64)
        fp = ((keys >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        i = (keys * _M >> np.uint64(16)) & np.uint64(self.buckets - 1)
        return fp, i.astype(np.int64), self._other(i.astype(np.int64), fp)

    def _other(self, i: np.ndarray, fp: np.ndarray) -> np.ndarray:
        return i ^ ((fp.astype(np.uint64) * _M >> np.uint64(20)) & np.uint64(self.buckets - 1)).astype(np.int64)

    def bulk(self, keys: np.ndarray) -> bool:
        fp, i, j = self._places(keys)
        left = np.arange(len(fp))
        for at in (i, j):
            for slot in range(SLOTS):
                free = left[self.table[at[left], slot] == 0]
                first = free[np.unique(at[free], return_index=True)[1]]  # one key a bucket and turn
                self.table[at[first], slot] = fp[first]
                left = np.setdiff1d(left, first, assume_unique=True)
        return all(self._kick(int(fp[k]), int(i[k])) for k in left)

    def _kick(self, fp: int, at: int) -> bool:
        for turn in range(KICKS):
            row = self.table[at]
            free = np.flatnonzero(row == 0)
            if len(free):
                row[free[0]] = fp
                return True
            slot = (turn * 7 + fp) % SLOTS
            fp, row[slot] = int(row[slot]), fp
            at = int(self._other(np.array([at]), np.array([fp], np.uint16))[0])
        return False

    def __contains__(self, key: int) -> bool:
        return bool(self.has(np.array([key]))[0])

    def has(self, keys: np.ndarray) -> np.ndarray:
        fp, i, j = self._places(keys)
        return ((self.table[i] == fp[:, None]) | (self.table[j] == fp[:, None])).any(axis=1)

    def remove(self, keys: np.ndarray) -> int:
        """Takes out one fingerprint a key; keys must have been inserted. The number found."""
        found = 0
        for f, *both in zip(*self._places(keys), strict=True):
            for at in both:
                slots = np.flatnonzero(self.table[at] == f)
                if len(slots):
                    self.table[at, slots[0]] = 0
                    found += 1
                    break
        return found

    def count(self) -> int:
        return int((self.table != 0).sum())

    def tobytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def frombytes(cls, raw: bytes) -> CuckooFilter:
        out = cls(len(raw) // (2 * SLOTS))
        out.table = np.frombuffer(raw, np.uint16).reshape(-1, SLOTS).copy()
        return out
