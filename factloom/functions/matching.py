"""Matching blocks of two texts, as difflib finds them without junk, in numpy over windows instead of character by character.

The longest common run, the first of these in the one text and then in the other, splits
both texts, and so on with what stands left and right of it. Windows of 1, 2, 4, ... characters of the longer text get
the number of the equal window of the shorter one, or none: a window is known by the numbers of its two halves, so numbers
stand for equal texts exactly. A window of any length is known by two windows that overlap. The longest run of a part is
then found by bisection over lengths, each a lookup of the part's windows.
"""

from __future__ import annotations

import numpy as np


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def _numbered(long: np.ndarray, short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the values of both, the short one's; -1 for what only the long one has, or for a window without a number."""
    known = np.unique(short[short >= 0])
    if not len(known):
        return np.full(len(long), -1), np.full(len(short), -1)
    out = []
    for x in (long, short):
        at = np.minimum(np.searchsorted(known, x), len(known) - 1)
        out.append(np.where((known[at] == x) & (x >= 0), at, -1))
    return out[0], out[1]


class Windows:
    """Numbers of the windows of 2^t characters of a page and a snippet."""

    def __init__(self, page: str, snippet: str):
        levels = [_numbered(_codes(page), _codes(snippet))]
        size = 1
        while 2 * size <= min(len(page), len(snippet)):
            a, b = levels[-1]
            levels.append(_numbered(self._pairs(a, size, len(snippet)), self._pairs(b, size, len(snippet))))
            size *= 2
        self.levels, self.base = levels, len(snippet) + 1

    @staticmethod
    def _pairs(x: np.ndarray, apart: int, base: int) -> np.ndarray:
        first, second = x[: len(x) - apart], x[apart:]
        return np.where((first >= 0) & (second >= 0), first * (base + 1) + second, -1)

    def of(self, size: int, alo: int, ahi: int, blo: int, bhi: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the windows of a size within a part of the page and of the snippet."""
        t = size.bit_length() - 1
        shift = size - (1 << t)
        out = []
        for x, lo, hi in zip(self.levels[t], (alo, blo), (ahi, bhi), strict=True):
            first, second = x[lo : hi - size + 1], x[lo + shift : hi - size + 1 + shift]
            out.append(np.where((first >= 0) & (second >= 0), first * self.base + second, -1))
        return out[0], out[1]

    def longest(self, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
        """(start in the page, start in the snippet, size) of the longest common run, the first of them."""
        low, high, best = 0, min(ahi - alo, bhi - blo), None
        while low < high:  # a run of a size has runs of all smaller ones
            size = (low + high + 1) // 2
            a, b = self.of(size, alo, ahi, blo, bhi)
            hit = np.flatnonzero(np.isin(a, b[b >= 0]))
            if len(hit):
                low, best = size, (alo + int(hit[0]), blo + int(np.flatnonzero(b == a[hit[0]])[0]))
            else:
                high = size - 1
        return (*best, low) if best else (alo, blo, 0)


def matching_size(page: str, snippet: str) -> int:
    """Characters in matching blocks, the sum over difflib.SequenceMatcher(None, page, snippet, autojunk=False).get_matching_blocks()."""
    if not page or not snippet:
        return 0
    windows, parts, total = Windows(page, snippet), [(0, len(page), 0, len(snippet))], 0
    while parts:
        alo, ahi, blo, bhi = parts.pop()
        if alo >= ahi or blo >= bhi:
            continue
        i, j, size = windows.longest(alo, ahi, blo, bhi)
        if size:
            total += size
            parts += [(alo, i, blo, j), (i + size, ahi, j + size, bhi)]
    return total
