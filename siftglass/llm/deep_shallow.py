"""Deep-shallow sorting of byte strings.

Strings are first ordered by multikey quicksort, eight bytes to a key, down to a shallow depth: each
segment of strings that agree so far is parted around a pivot into smaller, equal and larger keys, and the
equal ones go on with the next key.  All segments are parted at once, level by level.  Strings that still
agree at the shallow depth form deep groups; each is ordered by a blind trie, which keeps only branching
places and leaves, so that a string is compared with one other when it is put in.
"""

from __future__ import annotations

import numpy as np

#: Bytes that quicksort looks at before blind tries take over.
SHALLOW = 64
_KEY = 8


def _keys(strings: list[bytes]) -> np.ndarray:
    """The first SHALLOW bytes as rows of big-endian integers; short strings are filled with zeros."""
    rows = b"".join([s[:SHALLOW].ljust(SHALLOW, b"\0") for s in strings])
    return np.frombuffer(rows, ">u8").reshape(len(strings), SHALLOW // _KEY).astype(np.uint64)


def _common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


class BlindTrie:
    """A trie of distinct strings that stores branching depths and the bytes that branch.

    A string that ends at a branching place takes the branch -1, before all bytes.
    """

    def __init__(self, strings: list[bytes]) -> None:
        self.strings = strings
        self.root: list | int | None = None

    def insert(self, k: int) -> None:
        """Put in string number ``k``."""
        strings, s = self.strings, self.strings[k]
        if self.root is None:
            self.root = k
            return
        node, size = self.root, len(s)
        while type(node) is list:  # blind descent: only branching bytes are looked at
            depth, branches = node
            node = branches.get(s[depth] if depth < size else -1)
            if node is None:
                node = next(iter(branches.values()))
        other = strings[node]
        shared = _common(s, other)
        mine = s[shared] if shared < size else -1
        parent, branch, node = None, -1, self.root
        while type(node) is list and node[0] < shared:
            parent, branch = node, (s[node[0]] if node[0] < size else -1)
            node = node[1][branch]
        if type(node) is list and node[0] == shared:
            node[1][mine] = k
            return
        theirs = other[shared] if shared < len(other) else -1
        fresh = [shared, {mine: k, theirs: node}]
        if parent is None:
            self.root = fresh
        else:
            parent[1][branch] = fresh

    def ordered(self) -> list[int]:
        """The numbers of the strings in ascending order."""
        out: list[int] = []
        stack = [] if self.root is None else [self.root]
        while stack:
            node = stack.pop()
            if type(node) is list:
                branches = node[1]
                stack += [branches[c] for c in sorted(branches, reverse=True)]
            else:
                out.append(node)
        return out


def _quicksort(keys: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by (group, keys) and the first place of each string's segment of full agreement."""
    n, depth_end = keys.shape
    order = np.argsort(group, kind="stable")
    start = np.zeros(n, np.int64)  # of the segment that each place lies in
    ordered_group = group[order]
    edge = np.flatnonzero(np.diff(ordered_group, prepend=ordered_group[:1] - 1)) if n else np.zeros(0, np.int64)
    start = np.repeat(edge, np.diff(np.append(edge, n)))
    depth = np.zeros(n, np.int64)  # by place
    while True:
        first = np.flatnonzero(start == np.arange(n))
        size = np.diff(np.append(first, n))
        active = np.repeat((size > 1) & (depth[first] < depth_end), size)
        places = np.flatnonzero(active)
        if not len(places):
            return order, start
        s = start[places]
        at = depth[places]
        value = keys[order[places], at]
        sizes = size[np.searchsorted(first, s)]
        pivot = keys[order[s + sizes // 2], at]
        side = (value > pivot).astype(np.int64) + (value >= pivot)  # 0 smaller, 1 equal, 2 larger
        by = np.argsort(s * 3 + side, kind="stable")
        order[places] = order[places][by]
        side, s = side[by], s[by]
        depth[places] = at[by] + (side == 1)
        edge = np.ones(len(places), bool)
        edge[1:] = (s[1:] != s[:-1]) | (side[1:] != side[:-1])
        firsts = np.flatnonzero(edge)
        start[places] = np.repeat(places[firsts], np.diff(np.append(firsts, len(places))))


def deep_shallow_sort(strings: list[bytes], group: np.ndarray) -> np.ndarray:
    """The numbers of the strings in the order of (group, string); equal strings stand together."""
    if not strings:
        return np.zeros(0, np.int64)
    order, start = _quicksort(_keys(strings), np.asarray(group, np.int64))
    first = np.flatnonzero(start == np.arange(len(start)))
    size = np.diff(np.append(first, len(start)))
    for at, n in zip(first[size > 1].tolist(), size[size > 1].tolist(), strict=True):
        numbers = order[at : at + n].tolist()
        same: dict[bytes, list[int]] = {}
        for k in numbers:
            same.setdefault(strings[k], []).append(k)
        distinct = list(same)
        if len(distinct) > 1:
            trie = BlindTrie(distinct)
            for k in range(len(distinct)):
                trie.insert(k)
            order[at : at + n] = [k for d in trie.ordered() for k in same[distinct[d]]]
        else:
            order[at : at + n] = numbers
    return order


def neighbour_prefixes(strings: list[bytes], group: np.ndarray, order: np.ndarray, block: int = 4096) -> np.ndarray:
    """For each place of an order, the common prefix with the place before; -1 where the group changes."""
    n = len(order)
    out = np.full(n, -1, np.int64)
    for at in range(1, n, block):
        stop = min(n, at + block)
        some = [strings[k] for k in order[at - 1 : stop].tolist()]
        lengths = np.array([len(s) for s in some])
        width = max(1, int(lengths.max()))
        rows = np.frombuffer(b"".join([s.ljust(width, b"\0") for s in some]), np.uint8).reshape(len(some), width)
        differ = rows[1:] != rows[:-1]
        shared = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        out[at:stop] = np.minimum(shared, np.minimum(lengths[1:], lengths[:-1]))
    out[1:][group[order[1:]] != group[order[:-1]]] = -1
    return out
