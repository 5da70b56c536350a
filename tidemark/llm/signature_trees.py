"""Signature trees over sets, and their dual traversal; many trees of one task at once.

A tree's nodes have ``FAN`` children each.  A node holds the OR of the bitmaps
of the sets below it, the range of their sizes, and how many elements a set has
beyond the bits it sets.  A traversal begins with pairs of roots; a pair of
nodes is dropped where the largest overlap that bitmaps and sizes allow is less
than a link needs, or where all below both is one component already.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

FAN = 16
#: Pairs of nodes that are opened, and pairs of sets that are compared, at a time.
OPENED, COMPARED = 2048, 16_384


def needed(a, b, percent: int):
    """100 * overlap is at least percent * union: what (100 + percent) * overlap must reach."""
    return percent * (a + b)


class Forest:
    """Components of 0 to n - 1: ``root`` is the smallest number of each one's component."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.root[a], self.root[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            root = self.root.copy()  # what has been joined shows by a new array
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(root[root], root):
                root = root[root]
            self.root = root


@dataclass
class Level:
    bits: np.ndarray
    least: np.ndarray
    most: np.ndarray
    spare: np.ndarray
    #: First row of each node, and the first of its children.
    row: np.ndarray
    child: np.ndarray

    def may(self, p: np.ndarray, q: np.ndarray, percent: int) -> np.ndarray:
        """Whether a set below p and one below q may link."""
        sizes = (self.least[p] * percent <= self.most[q] * 100) & (self.least[q] * percent <= self.most[p] * 100)
        at = np.flatnonzero(sizes)
        a, b = p[at], q[at]
        overlap = np.bitwise_count(self.bits[a] & self.bits[b]).sum(1).astype(np.int64) + np.minimum(self.spare[a], self.spare[b])
        sizes[at] = (100 + percent) * overlap >= needed(self.least[a], self.least[b], percent)
        return sizes


def _heads(tree: np.ndarray, place: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, (tree[1:] != tree[:-1]) | (place[1:] // FAN != place[:-1] // FAN)))


def grown(tree: np.ndarray, n: np.ndarray, bits: np.ndarray) -> list[Level]:
    """The levels of all trees, from the sets (in the order of ``tree``) up to one root a tree."""
    rows = np.arange(len(n))
    out = [Level(bits, n, n, n - np.bitwise_count(bits).sum(1).astype(np.int64), rows, rows)]
    while len(tree) and (tree[1:] == tree[:-1]).any():
        below = out[-1]
        first = np.flatnonzero(np.append(True, tree[1:] != tree[:-1]))
        place = np.arange(len(tree)) - np.repeat(first, np.diff(np.append(first, len(tree))))
        head = _heads(tree, place)
        out.append(Level(np.bitwise_or.reduceat(below.bits, head), np.minimum.reduceat(below.least, head), np.maximum.reduceat(below.most, head), np.maximum.reduceat(below.spare, head), below.row[head], head))
        tree = tree[head]
    return out


def traverse(levels: list[Level], pairs: np.ndarray, percent: int, who: np.ndarray, forest: Forest, meet: Callable[[np.ndarray, np.ndarray], None]) -> None:
    """Call ``meet`` with rows (p, q) that may link, are of two components, and are below ``pairs`` of roots.

    ``who`` is each row's number in ``forest``, which ``meet`` changes: what it
    has joined is not compared again.
    """
    held = [(len(levels) - 1, pairs[:, 0], pairs[:, 1])]
    one: dict[int, tuple] = {}
    seen = forest.root
    while held:
        at, p, q = held.pop()
        most = OPENED if at else COMPARED
        if len(p) > most:
            held.append((at, p[most:], q[most:]))
            p, q = p[:most], q[:most]
        if seen is not forest.root:
            one, seen = {}, forest.root
        if not at:
            root = seen[who]
            apart = root[p] != root[q]
            p, q = p[apart], q[apart]
            ok = levels[0].may(p, q, percent)
            if ok.any():
                meet(p[ok], q[ok])
            continue
        level = levels[at]
        if at not in one:
            root = seen[who]
            one[at] = np.minimum.reduceat(root, level.row), np.maximum.reduceat(root, level.row)
        low, high = one[at]
        same = (low[p] == high[p]) & (low[q] == high[q]) & (low[p] == low[q])
        p, q = p[~same], q[~same]
        ok = level.may(p, q, percent)
        p, q = p[ok], q[ok]
        end = np.append(level.child[1:], len(levels[at - 1].row))
        inside = p == q
        for a, b, self_ in ((p[~inside], q[~inside], False), (p[inside], q[inside], True)):  # the pairs within a node are taken first
            if not len(a):
                continue
            x, y = end[a] - level.child[a], end[b] - level.child[b]
            which = np.repeat(np.arange(len(a)), x * y)
            step = np.arange(len(which)) - np.repeat(np.cumsum(x * y) - x * y, x * y)
            left, right = level.child[a][which] + step // y[which], level.child[b][which] + step % y[which]
            if self_:
                use = left < right if at == 1 else left <= right
                left, right = left[use], right[use]
            held.append((at - 1, left, right))
