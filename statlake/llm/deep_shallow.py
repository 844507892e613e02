"""Deep-shallow sorting of fixed-length suffixes: multikey quicksort to a shallow depth, then blind tries.

Used inside Spark tasks on bounded pieces of text (see ``suffix_dedup``).
"""

from __future__ import annotations

import numpy as np

#: Bytes compared by the shallow sort, and bytes that make one character of its multikey quicksort.
SHALLOW, CHUNK = 24, 8


def words_at(text: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The 8 bytes at each start as big-endian numbers (compare like the bytes). ``text`` has 8 bytes to spare."""
    every = np.ndarray((len(text) - 7,), "<u8", text, 0, (1,))
    return every[start].byteswap()


def shallow_groups(text: np.ndarray, start: np.ndarray, group: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of suffixes inside given groups to depth ``shallow``.

    All groups are partitioned at once, one 8-byte character a level; a
    suffix that is alone in its part is in its final place and leaves.
    Returns (suffix indexes in order, part number of each) of the parts with
    two or more suffixes, which share their first ``shallow`` bytes.
    """
    order = np.argsort(group, kind="stable")
    part = group[order]
    for depth in range(0, shallow, CHUNK):
        if not len(order):
            break
        key = words_at(text, start[order] + depth)
        inner = np.lexsort((key, part))
        order, part, key = order[inner], part[inner], key[inner]
        new = np.r_[True, (part[1:] != part[:-1]) | (key[1:] != key[:-1])]
        number = np.cumsum(new) - 1
        shared = np.bincount(number)[number] > 1
        order, part = order[shared], number[shared]
    return order, part


class BlindTrie:
    """A Patricia trie of byte strings of one length: nodes hold only a branching depth and first bytes.

    An inserted string is led down by its bytes at the branching depths,
    compared once with a string of the part it reaches (the blind search may
    have passed differences), and placed at the first difference.
    """

    __slots__ = ("root",)

    def __init__(self) -> None:
        self.root = None

    def insert(self, string: bytes, item: int) -> None:
        if self.root is None:
            self.root = (string, [item])
            return
        node, path = self.root, []
        while len(node) == 3:  # (depth, children, some string below)
            path.append(node)
            child = node[1].get(string[node[0]])
            if child is None:
                break
            node = child
        seen = node[2] if len(node) == 3 else node[0]
        lcp = common_prefix(string, seen)
        if lcp == len(string):  # only a leaf holds the whole string
            node[1].append(item)
            return
        at = 0
        while at < len(path) and path[at][0] < lcp:
            at += 1
        if at < len(path) and path[at][0] == lcp:
            path[at][1][string[lcp]] = (string, [item])
            return
        below = path[at] if at < len(path) else node
        fork = (lcp, {string[lcp]: (string, [item]), seen[lcp]: below}, seen)
        if at:
            up = path[at - 1]
            up[1][seen[up[0]]] = fork
        else:
            self.root = fork

    def leaves(self) -> list[list[int]]:
        """The items of equal strings together, the strings in order."""
        out, stack = [], [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if len(node) == 2:
                out.append(node[1])
            else:
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
        return out


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the common prefix of two strings of one length."""
    if a == b:
        return len(a)
    differ = int.from_bytes(a, "big") ^ int.from_bytes(b, "big")
    return len(a) - (differ.bit_length() + 7) // 8


def equal_suffixes(text: np.ndarray, start: np.ndarray, group: np.ndarray, length: int) -> list[list[int]]:
    """Lists of the suffixes (indexes into ``start``) of one group with equal first ``length`` bytes, two or more each.

    Shallow sort first; a blind trie then orders each part that still shares
    a prefix. ``text`` has at least ``length`` + 8 bytes after every start.
    """
    order, part = shallow_groups(text, start, group, SHALLOW if length >= SHALLOW else length // CHUNK * CHUNK)
    if not len(order):
        return []
    skip = min(SHALLOW, length // CHUNK * CHUNK)
    raw, begin = text.tobytes(), (start[order] + skip).tolist()
    bounds = [*np.flatnonzero(np.r_[True, part[1:] != part[:-1]]).tolist(), len(order)]
    items, rest, out = order.tolist(), length - skip, []
    for lo, hi in zip(bounds, bounds[1:]):
        trie = BlindTrie()
        for i in range(lo, hi):
            trie.insert(raw[begin[i]: begin[i] + rest], items[i])
        out += [leaf for leaf in trie.leaves() if len(leaf) > 1]
    return out
