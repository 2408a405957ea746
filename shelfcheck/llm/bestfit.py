"""Best-fit-decreasing bin packing of runs of equal sizes, with open bins in a balanced tree.

Items of one size that follow each other enter the same bin until it is full, since a bin that has just taken
one is the tightest that can. So a whole run of equal items is placed at once, on bins that are kept by remaining
capacity, equal ones together, and the work follows the number of distinct sizes, not of items.
"""

from __future__ import annotations

from dataclasses import dataclass


class _Node:
    __slots__ = ("high", "key", "left", "right", "value")

    def __init__(self, key: int, value: list):
        self.key, self.value, self.left, self.right, self.high = key, value, None, None, 1


class BalancedTree:
    """A search tree (AVL) from remaining capacity to a list of bins."""

    def __init__(self):
        self.root = None

    def ceiling(self, key: int) -> _Node | None:
        """The smallest key of at least ``key``."""
        node, best = self.root, None
        while node:
            if node.key >= key:
                node, best = node.left, node
            else:
                node = node.right
        return best

    def add(self, key: int, item) -> None:
        self.root = self._add(self.root, key, item)

    def remove(self, key: int) -> None:
        self.root = self._remove(self.root, key)

    def _add(self, node, key, item):
        if node is None:
            return _Node(key, [item])
        if key == node.key:
            node.value.append(item)
            return node
        if key < node.key:
            node.left = self._add(node.left, key, item)
        else:
            node.right = self._add(node.right, key, item)
        return _balanced(node)

    def _remove(self, node, key):
        if node is None:
            return None
        if key < node.key:
            node.left = self._remove(node.left, key)
        elif key > node.key:
            node.right = self._remove(node.right, key)
        elif node.left is None or node.right is None:
            return node.left or node.right
        else:
            least = node.right
            while least.left:
                least = least.left
            node.key, node.value = least.key, least.value
            node.right = self._remove(node.right, least.key)
        return _balanced(node)


def _high(node) -> int:
    return node.high if node else 0


def _turned(node, left: bool):
    """Rotate so that the child on the other side comes up."""
    if left:
        up = node.right
        node.right, up.left = up.left, node
    else:
        up = node.left
        node.left, up.right = up.right, node
    for x in (node, up):
        x.high = 1 + max(_high(x.left), _high(x.right))
    return up


def _balanced(node):
    lean = _high(node.left) - _high(node.right)
    if lean > 1:
        if _high(node.left.left) < _high(node.left.right):
            node.left = _turned(node.left, True)
        return _turned(node, False)
    if lean < -1:
        if _high(node.right.right) < _high(node.right.left):
            node.right = _turned(node.right, False)
        return _turned(node, True)
    node.high = 1 + max(_high(node.left), _high(node.right))
    return node


@dataclass
class Run:
    """Items rank to rank + n of one size: item i goes to bin ``first_bin + i // per_bin``."""

    size: int
    rank: int
    n: int
    first_bin: int
    per_bin: int


def best_fit_runs(classes, capacity: int, bins: int | None = None) -> tuple[list[Run], int] | None:
    """Place (size, count) classes, largest size first, into bins of ``capacity``.

    Returns the runs and the number of bins; None if more than ``bins`` bins would be needed. A size above the
    capacity gets bins of its own.
    """
    tree, runs, used = BalancedTree(), [], 0
    for size, count in classes:
        rank = 0
        while rank < count:
            node, left = tree.ceiling(size), count - rank
            if node is None:
                per = max(1, capacity // size)
                new = max(1, left // per)
                first, n, got = used, new, min(left, new * per)
                rem = capacity
                used += new
                if bins is not None and used > bins:
                    return None
            else:
                rem, (first, n) = node.key, node.value.pop()
                if not node.value:
                    tree.remove(rem)
                per = rem // size
                fill = min(n, left // per)
                if fill < n:  # bins that stay as they are
                    keep = n - max(1, fill)
                    if keep:
                        tree.add(rem, (first + max(1, fill), keep))
                n, got = max(1, fill), min(left, max(1, fill) * per)
            runs.append(Run(size, rank, got, first, per))
            rank += got
            each = got // n if got == n * per else got
            if rem - each * size > 0:
                tree.add(rem - each * size, (first, n))
    return runs, used
