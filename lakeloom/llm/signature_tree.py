"""Signature trees: nodes with OR-combined token bitmaps and size ranges, joined by dual traversal."""

from __future__ import annotations

import numpy as np

#: Bits of a set's bitmap.
BITS = 2048
#: Sets in a leaf, and children of a node.
LEAF, FAN = 16, 4


class Forest:
    """Disjoint sets over 0..n-1."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return int(i)

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)

    def roots(self, members: np.ndarray) -> np.ndarray:
        """The root of each member."""
        at = self.parent[members]
        while not np.array_equal(up := self.parent[at], at):
            at = up
        return at

    def flat(self) -> np.ndarray:
        while not np.array_equal(up := self.parent[self.parent], self.parent):
            self.parent = up
        return self.parent


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """A row of 64-bit words for each set, a bit for each token."""
    out = np.zeros((len(sets), BITS // 8), np.uint8)
    for row, tokens in zip(out, sets, strict=True):
        bit = (tokens % np.uint64(BITS)).astype(np.int64)
        np.bitwise_or.at(row, bit >> 3, (1 << (bit & 7)).astype(np.uint8))
    return out.view(np.uint64)


class Tree:
    """A tree over the members order[i]: levels of nodes from leaves to the root."""

    def __init__(self, members: np.ndarray, sizes: np.ndarray, maps: np.ndarray, spare: np.ndarray):
        # Sets of like size and like bitmap stand together, so that a node's union stays sparse.
        self.order = members[np.lexsort((*maps[members].T[:4], sizes[members]))]
        cuts = np.arange(0, len(self.order), LEAF)
        low, high = sizes[self.order], sizes[self.order]
        level = (np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts), np.bitwise_or.reduceat(maps[self.order], cuts), np.maximum.reduceat(spare[self.order], cuts))
        self.levels = [level]
        while len(level[0]) > 1:
            cuts = np.arange(0, len(level[0]), FAN)
            level = (np.minimum.reduceat(level[0], cuts), np.maximum.reduceat(level[1], cuts), np.bitwise_or.reduceat(level[2], cuts), np.maximum.reduceat(level[3], cuts))
            self.levels.append(level)

    def leaf(self, i: int) -> np.ndarray:
        return self.order[i * LEAF : (i + 1) * LEAF]


def possible(a, b, percent: int) -> np.ndarray:
    """Whether sets under the nodes (or sets) a and b, pairwise, can reach the similarity.

    a and b are (least size, greatest size, bitmap, spare): spare is the most
    tokens of a set beyond its bits. Tokens in common fall on bits in common,
    so a pair shares at most those bits and the smaller spare.
    """
    low = 100 * np.minimum(a[1], b[1]) >= percent * np.maximum(a[0], b[0])
    most = np.bitwise_count(a[2] & b[2]).sum(-1, dtype=np.int64) + np.minimum(a[3], b[3])
    most = np.minimum(most, np.minimum(a[1], b[1]))
    return low & ((100 + percent) * most >= percent * (a[0] + b[0]))


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, exactly."""
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def link(sets: list[np.ndarray], percent: int, side: np.ndarray | None = None, forest: Forest | None = None) -> tuple[np.ndarray, int]:
    """(roots of the components that links form among sets, pairs compared exactly).

    With side (0 or 1 for each set) only pairs across sides are sought. A pair
    already connected, in the given forest too, isn't compared again.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    maps = bitmaps(sets)
    spare = sizes - np.bitwise_count(maps).sum(1, dtype=np.int64)
    forest, compared = forest or Forest(n), 0
    everyone = np.arange(n)
    trees = [Tree(everyone, sizes, maps, spare)] * 2 if side is None else [Tree(everyone[side == s], sizes, maps, spare) for s in (0, 1) if (side == s).any()]
    if len(trees) < 2:
        return forest.flat(), 0
    left, right = trees
    tops = len(left.levels) - 1, len(right.levels) - 1
    todo = [(tops[0], 0, tops[1], 0)]
    while todo:
        la, a, lb, b = todo.pop()
        if la or lb:
            # Descend the higher node; children that can't hold a similar pair are pruned.
            down_left = la >= lb
            la2, lb2 = (la - 1, lb) if down_left else (la, lb - 1)
            tree, level, node = (left, la2, a) if down_left else (right, lb2, b)
            kids = np.arange(node * FAN, min((node + 1) * FAN, len(tree.levels[level][0])))
            mine = tuple(x[kids] for x in tree.levels[level])
            other = tuple(x[b : b + 1] for x in right.levels[lb]) if down_left else tuple(x[a : a + 1] for x in left.levels[la])
            for kid in kids[possible(mine, other, percent)].tolist():
                pair = (la2, kid, lb, b) if down_left else (la, a, lb2, kid)
                # In a self join nodes of one level are paired once.
                if not (left is right and pair[0] == pair[2] and pair[1] > pair[3]):
                    todo.append(pair)
            continue
        rows, cols = left.leaf(a), right.leaf(b)
        fits = possible(*(tuple(x[:, None] if k == 0 else x[None] for x in (sizes[m], sizes[m], maps[m], spare[m])) for k, m in enumerate((rows, cols))), percent)
        root = forest.flat()
        fits &= root[rows][:, None] != root[cols][None]
        for i, j in np.argwhere(fits).tolist():
            x, y = int(rows[i]), int(cols[j])
            if forest.root(x) != forest.root(y):
                compared += 1
                if similar(sets[x], sets[y], percent):
                    forest.join(x, y)
    return forest.flat(), compared
