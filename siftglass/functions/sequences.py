"""Matching blocks of two sequences, as the standard library's matcher picks them, in arrays of a few bytes an item.

The matcher takes the longest common run (the earliest in the first sequence, then in the second) and goes on
to its left and right.  Here runs of one length are found by their hashes, which are told from sums over the whole
sequences, and compared item by item before they count.  All blocks of one length are taken in one pass, so lengths fall
from a gap to the gaps inside it: no gap is deeper than the square root of twice the length.
"""

from __future__ import annotations

from collections.abc import Hashable, Iterator, Sequence

import numpy as np

#: An odd number and its inverse by 2^64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _codes(a: Sequence[Hashable], b: Sequence[Hashable]) -> tuple[np.ndarray, np.ndarray]:
    """Both sequences as numbers, equal ones for equal items."""
    if isinstance(a, str) and isinstance(b, str):
        one, other = (np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32) for s in (a, b))
        return one, other
    numbers: dict[Hashable, int] = {}
    one, other = (np.fromiter((numbers.setdefault(x, len(numbers)) for x in s), np.uint32, len(s)) for s in (a, b))
    return one, other


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _common_start(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    other = a[:n] != b[:n]
    return int(other.argmax()) if other.any() else n


class _Pair:
    """Two sequences and what tells the hash of any run of theirs."""

    def __init__(self, a: np.ndarray, b: np.ndarray) -> None:
        self.a, self.b = a, b
        power = _powers(_BASE, max(len(a), len(b)))
        self.back = _powers(_INVERSE, max(len(a), len(b)))
        self.sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum((s.astype(np.uint64) + np.uint64(1)) * power[: len(s)], dtype=np.uint64)]) for s in (a, b)]

    def _hashes(self, side: int, start: int, end: int, n: int) -> np.ndarray:
        sums = self.sums[side]
        return (sums[start + n : end + 1] - sums[start : end + 1 - n]) * self.back[start : end + 1 - n]

    def blocks(self, i: int, k: int, j: int, l: int, n: int) -> Iterator[tuple[int, int]]:  # noqa: E741
        """Common runs of ``n`` items of ``a[i:k]`` and ``b[j:l]``, each the earliest behind the one before."""
        there = self._hashes(1, j, l, n)
        order = there.argsort(kind="stable")
        ranked = there[order]
        here = self._hashes(0, i, k, n)
        first = ranked.searchsorted(here)
        at = np.flatnonzero(ranked[np.minimum(first, len(ranked) - 1)] == here)
        first, last = first[at], ranked.searchsorted(here[at], "right")
        # What isn't behind the block before can't be used any more, so each start in the second sequence is met once for a hash.
        passed: dict[int, int] = {}
        x, y = i, j
        for p, lo, hi in zip(at.tolist(), first.tolist(), last.tolist(), strict=True):
            if i + p < x:
                continue
            where = order[lo:hi]
            q = passed[lo] = int(where.searchsorted(y - j)) if lo not in passed else passed[lo] + int(where[passed[lo] :].searchsorted(y - j))
            for s in where[q:]:
                if np.array_equal(self.a[i + p : i + p + n], self.b[j + s : j + s + n]):
                    yield i + p, j + int(s)
                    x, y = i + p + n, j + int(s) + n
                    break

    def longest(self, i: int, k: int, j: int, l: int, most: int) -> int:  # noqa: E741
        """The length of the longest common run, known not to be above ``most``."""
        low = min(most, max(_common_start(self.a[i:k], self.b[j:l]), _common_start(self.a[i:k][::-1], self.b[j:l][::-1])))
        n = min(low + 1, most)
        while low < most:
            if next(self.blocks(i, k, j, l, n), None):
                low = n
            else:
                most = n - 1
            n = (low + most + 1) // 2
        return low


def compare(a: Sequence[Hashable], b: Sequence[Hashable]) -> tuple[int, int]:
    """(matched, edits): items in matching blocks, and the larger side of each gap between blocks, summed."""
    matched = edits = 0
    pair = _Pair(*_codes(a, b))
    todo = [(0, len(a), 0, len(b), min(len(a), len(b)))]
    while todo:
        i, k, j, l, most = todo.pop()  # noqa: E741
        most = min(most, k - i, l - j)
        n = pair.longest(i, k, j, l, most) if most else 0
        if not n:
            edits += max(k - i, l - j)
            continue
        for x, y in pair.blocks(i, k, j, l, n):
            matched += n
            todo.append((i, x, j, y, n - 1))
            i, j = x + n, y + n
        todo.append((i, k, j, l, n - 1))
    return matched, edits


def ratio(a: Sequence[Hashable], b: Sequence[Hashable]) -> float:
    """Twice the matched items over all items; 1 for two empty sequences."""
    total = len(a) + len(b)
    return 2.0 * compare(a, b)[0] / total if total else 1.0
