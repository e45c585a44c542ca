"""Signature trees: sets under nodes that hold the OR of their token bitmaps and the range of their sizes.

:func:`join` links the sets of one bounded group whose Jaccard similarity reaches a limit. It walks
pairs of nodes from the roots down and leaves a pair when no two sets below can be alike enough:

* by size: the smaller size over the larger is below the limit;
* by overlap: a set has at most as many tokens in common with a set below the other node as its bits
  in common with that node's bitmap, plus the tokens of it that share a bit;
* by connection: all sets below both nodes are linked already, directly or through others
  (:func:`tally`, which counts all links, goes without this rule);
* by distance, where every set's Jaccard distance to a hub is known: two distances that add up to no more
  than the limit make a link sure, two that differ by more than it rule one out. Sure links are counted by
  rank, without their pairs.

What is left at the leaves is compared bit by bit, then token by token.
"""

from __future__ import annotations

import numpy as np

LEAF, FAN = 64, 8
_ONE = 1 << 40  # a distance of 1; distances are whole numbers, rounded up


def bitmap(tokens: np.ndarray, words: int) -> np.ndarray:
    """Bits of the tokens in ``words`` 64-bit words, a power of two."""
    places = (tokens >> np.uint64(20)) & np.uint64(64 * words - 1)
    out = np.zeros(words, np.uint64)
    np.bitwise_or.at(out, (places >> np.uint64(6)).astype(np.int64), np.uint64(1) << (places & np.uint64(63)))
    return out


def width(size: int, factor: int) -> int:
    """Words of a bitmap with at least ``factor`` bits a token."""
    return 1 << max(0, (max(1, size * factor) - 1).bit_length() - 6)


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """The bitmap in fewer words."""
    while len(bits) > words:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    return bits


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum()) if len(b) else 0


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = overlap(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def apart(a: np.ndarray, b: np.ndarray) -> int:
    """Jaccard distance of two sets that are not empty, in parts of ``_ONE``."""
    both = overlap(a, b)
    union = len(a) + len(b) - both
    return -(-(union - both) * _ONE // union)


class Links:
    """Union of linked sets."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


class Tree:
    """Levels of nodes over sets in a given order; level 0 has the leaves."""

    def __init__(self, order: np.ndarray, bits: np.ndarray, sizes: np.ndarray, near: np.ndarray):
        self.order = order
        spare = sizes - np.bitwise_count(bits).sum(1)  # tokens of a set that share a bit
        starts = np.arange(0, len(order), LEAF)
        level = (
            np.bitwise_or.reduceat(bits[order], starts, 0), np.minimum.reduceat(sizes[order], starts),
            np.maximum.reduceat(sizes[order], starts), np.maximum.reduceat(spare[order], starts),
            np.minimum.reduceat(near[order], starts), np.maximum.reduceat(near[order], starts),
        )
        self.levels = [level]
        while len(level[1]) > 1:
            starts = np.arange(0, len(level[1]), FAN)
            ufuncs = (np.bitwise_or, np.minimum, np.maximum, np.maximum, np.minimum, np.maximum)
            level = tuple(f.reduceat(x, starts, 0) for f, x in zip(ufuncs, level, strict=True))
            self.levels.append(level)

    def below(self, level: int, i: int) -> np.ndarray:
        """The sets below a node."""
        span = LEAF * FAN**level
        return self.order[i * span : (i + 1) * span]

    def children(self, level: int, i: int) -> range:
        return range(i * FAN, min((i + 1) * FAN, len(self.levels[level - 1][1])))


def _least(a, b, percent: int):
    """Tokens that sets of these sizes must share."""
    return -(-percent * (a + b) // (100 + percent))


def _may_link(x: tuple, i: int, y: tuple, j: int, percent: int, limit: int) -> bool:
    if x[5][i] + y[5][j] <= limit or max(x[4][i] - y[5][j], y[4][j] - x[5][i]) >= limit + 2:
        return False
    low, high = (x[1][i], y[1][j]), (x[2][i], y[2][j])
    if 100 * high[0] < percent * low[1] or 100 * high[1] < percent * low[0]:
        return False
    common = int(np.bitwise_count(x[0][i] & y[0][j]).sum())
    most = min(common + min(x[3][i], y[3][j]), high[0], high[1])
    return most >= _least(low[0], low[1], percent)


def pairs(bits: np.ndarray, sizes: np.ndarray, percent: int, links: Links, skip=None, near=None):
    """Pairs of sets that may be alike and are not linked yet. ``skip`` are labels of which equal ones need no pair.

    With ``near``, distances to a hub, pairs that they decide are left out, those sure to be alike too.
    """
    n = len(sizes)
    roots = np.array([links.root(i) for i in range(n)])
    limit = -1 if near is None else _limit(percent)  # below 0 nothing is decided
    near = np.zeros(n, np.int64) if near is None else near
    tree = Tree(np.lexsort((sizes, near, roots)), bits, sizes, near)
    spare = sizes - np.bitwise_count(bits).sum(1)
    top = len(tree.levels) - 1
    stack = [(top, 0, 0)]
    while stack:
        level, i, j = stack.pop()
        if not _may_link(tree.levels[level], i, tree.levels[level], j, percent, limit):
            continue
        a, b = tree.below(level, i), tree.below(level, j)
        first = links.root(int(a[0]))
        if level == 0 or len(a) + len(b) <= 4 * LEAF:
            if all(links.root(int(s)) == first for s in (*a, *b)):
                continue
        if level:
            for p in tree.children(level, i):
                stack += [(level - 1, p, q) for q in tree.children(level, j) if i != j or p <= q]
            continue
        both = np.bitwise_count(bits[a][:, None, :] & bits[b][None, :, :]).sum(2)
        most = both + np.minimum(spare[a][:, None], spare[b][None, :])
        fits = most >= _least(sizes[a][:, None], sizes[b][None, :], percent)
        small, large = np.minimum(sizes[a][:, None], sizes[b][None, :]), np.maximum(sizes[a][:, None], sizes[b][None, :])
        fits &= 100 * small >= percent * large
        fits &= near[a][:, None] + near[b][None, :] > limit
        fits &= np.abs(near[a][:, None] - near[b][None, :]) < limit + 2
        if skip is not None:
            fits &= skip[a][:, None] != skip[b][None, :]
        if i == j:
            fits &= np.triu(np.ones_like(fits), 1)
        for p, q in zip(*np.nonzero(fits), strict=True):
            if links.root(int(a[p])) != links.root(int(b[q])):
                yield int(a[p]), int(b[q])


def join(sets: list[np.ndarray], percent: int, hub: int | None = None, factor: int = 8) -> list[tuple[int, int]]:
    """Links between the sets that connect whatever is connected; the hub is compared with all first."""
    links, out = Links(len(sets)), []
    if hub is not None:
        for i, tokens in enumerate(sets):
            if i != hub and alike(sets[hub], tokens, percent) and links.join(hub, i):
                out.append((hub, i))
    if len(out) == len(sets) - 1:
        return out
    sizes = np.array([len(s) for s in sets], np.int64)
    words = min(width(int(sizes.max()), factor), 512)
    bits = np.stack([bitmap(s, words) for s in sets])
    for i, j in pairs(bits, sizes, percent, links):
        if alike(sets[i], sets[j], percent) and links.join(i, j):
            out.append((i, j))
    return out


def _limit(percent: int) -> int:
    """The largest distance of sets that are alike, rounded down."""
    return _ONE * (100 - percent) // 100


def _sure(near: np.ndarray, weights: np.ndarray, limit: int, label: np.ndarray | None) -> np.ndarray:
    """For every set the weight of the others whose distance and its own add up to ``limit`` at most; of
    another label only, if there are labels."""
    out = np.zeros(len(near), np.int64)
    for own in [None] if label is None else np.unique(label):
        mine = np.full(len(near), True) if label is None else label == own
        others = np.flatnonzero(mine if label is None else ~mine)
        others = others[np.argsort(near[others], kind="stable")]
        sums = np.concatenate([[0], np.cumsum(weights[others])])
        out[mine] = sums[np.searchsorted(near[others], limit - near[mine], side="right")]
    return out if label is not None else out - np.where(2 * near <= limit, weights, 0)


def tally(hub: np.ndarray, sets: list[np.ndarray], weights: np.ndarray, percent: int, label: np.ndarray | None = None, factor: int = 8) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links that connect whatever is connected, and for every set the weight of all sets linked with it.

    The hub is the first of the sets. With ``label`` it is none of them, links between sets of one label are
    left out, and links with the hub are known, so that what these connect is connected.
    """
    near = np.array([apart(hub, s) for s in sets], np.int64)
    counts = _sure(near, weights, _limit(percent), label)
    links, out = Links(len(sets)), []
    sure = np.flatnonzero(near <= _limit(percent)).tolist()
    for i in sure[1:]:
        links.join(sure[0], i)
        if label is None:
            out.append((0, i))
    sizes = np.array([len(s) for s in sets], np.int64)
    words = min(width(int(sizes.max()), factor), 512)
    bits = np.stack([bitmap(s, words) for s in sets])
    for i, j in pairs(bits, sizes, percent, Links(len(sets)), label, near):
        if alike(sets[i], sets[j], percent):
            counts[i] += weights[j]
            counts[j] += weights[i]
            if links.join(i, j):
                out.append((i, j))
    return out, counts
