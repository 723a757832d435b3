"""Signature trees: nodes with OR-combined token bitmaps and size ranges, joined by dual traversal.

Leaves are token sets (sorted 64-bit hashes).  A node knows the OR of its
leaves' bitmaps, the range of their sizes, and the most tokens that one of its
leaves loses to shared bits.  Two leaves share at most
    popcount(bits & bits) + tokens lost to shared bits,
so two nodes do with their ORs and maxima; where that can't reach what the
smallest sizes need, no leaf pair below can link and the pair is dropped.
"""

from __future__ import annotations

import numpy as np

BITS = 2048
FANOUT = 8


def links(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 |a and b| >= percent |a or b|, exactly; sorted distinct values."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    shared = int((large[at] == small).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


class SignatureTree:
    def __init__(self, sets: list[np.ndarray], groups: np.ndarray):
        """groups: a label for each set; pairs within one label aren't wanted."""
        sizes = np.array([len(s) for s in sets])
        first = np.array([s[0] if len(s) else 0 for s in sets], np.uint64)
        self.order = np.lexsort((first, sizes, groups))
        bits = np.zeros((len(sets), BITS // 64), np.uint64)
        for row, k in enumerate(self.order.tolist()):
            at = (sets[k] & np.uint64(BITS - 1)).astype(np.int64)
            flags = np.zeros(BITS, np.uint8)
            flags[at] = 1
            bits[row] = np.packbits(flags, bitorder="little").view(np.uint64)
        sizes, groups = sizes[self.order], groups[self.order]
        excess = sizes - np.bitwise_count(bits).sum(1).astype(np.int64)
        # level: bits, smallest size, largest size, largest excess, label (-1: mixed), end of children
        self.levels = [(bits, sizes, sizes, excess, groups)]
        while len(self.levels[-1][0]) > 1:
            b, low, high, ex, g = self.levels[-1]
            starts = np.arange(0, len(b), FANOUT)
            same = np.minimum.reduceat(g, starts) == np.maximum.reduceat(g, starts)
            self.levels.append((np.bitwise_or.reduceat(b, starts), np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts), np.maximum.reduceat(ex, starts), np.where(same, g[starts], -1)))


def _may(a, b, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which node pairs may hold a linked leaf pair of different labels."""
    low_a, low_b, high_a, high_b = a[1][i], b[1][j], a[2][i], b[2][j]
    ok = ((a[4][i] != b[4][j]) | (a[4][i] < 0)) & (100 * high_a >= percent * low_b) & (100 * high_b >= percent * low_a)
    at = np.flatnonzero(ok)
    for k in range(0, len(at), 16_384):
        part = at[k : k + 16_384]
        most = np.bitwise_count(a[0][i[part]] & b[0][j[part]]).sum(1).astype(np.int64) + np.minimum(a[3][i[part]], b[3][j[part]])
        most = np.minimum(most, np.minimum(high_a[part], high_b[part]))
        ok[part] = (100 + percent) * most >= percent * (low_a[part] + low_b[part])
    return ok


def candidates(a: SignatureTree, b: SignatureTree, percent: int):
    """Blocks of leaf pairs (positions in the given sets) that the bounds can't exclude; a may be b."""
    stack = [(len(a.levels) - 1, len(b.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        la, lb, i, j = stack.pop()
        if len(i) > 4_096:
            stack += [(la, lb, i[k : k + 4_096], j[k : k + 4_096]) for k in range(0, len(i), 4_096)]
            continue
        ok = _may(a.levels[la], b.levels[lb], i, j, percent)
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        if not la and not lb:
            if a is b:
                i, j = i[i < j], j[i < j]
            yield a.order[i], b.order[j]
            continue
        fan_a, fan_b = (FANOUT if la else 1), (FANOUT if lb else 1)
        i2 = (i[:, None] * fan_a + np.arange(fan_a))[:, :, None] if la else i[:, None, None]
        j2 = (j[:, None] * fan_b + np.arange(fan_b))[:, None, :] if lb else j[:, None, None]
        i2, j2 = np.broadcast_arrays(i2, j2)
        i2, j2 = i2.ravel(), j2.ravel()
        fits = (i2 < len(a.levels[la - 1 if la else 0][0])) & (j2 < len(b.levels[lb - 1 if lb else 0][0]))
        if a is b and la == lb:
            fits &= i2 <= j2
        stack.append((max(la - 1, 0), max(lb - 1, 0), i2[fits], j2[fits]))


def find_links(sets: list[np.ndarray], labels: np.ndarray, percent: int, sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join all labels which linked pairs join; `sides` 0/1: only pairs across them.

    A pair whose labels are joined already is skipped, so many sets that are all
    alike cost one link each and not one for every pair.
    """
    _, labels = np.unique(labels, return_inverse=True)
    root = list(range(int(labels.max()) + 1 if len(labels) else 0))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    if sides is None:
        tree = SignatureTree(sets, labels)
        blocks = ((i, j) for i, j in candidates(tree, tree, percent))
    else:
        left, right = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
        if not len(left) or not len(right):
            return []
        ta, tb = SignatureTree([sets[k] for k in left], labels[left]), SignatureTree([sets[k] for k in right], labels[right])
        blocks = ((left[i], right[j]) for i, j in candidates(ta, tb, percent))
    out = []
    for i, j in blocks:
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            p, q = find(int(labels[x])), find(int(labels[y]))
            if p != q and links(sets[x], sets[y], percent):
                root[max(p, q)] = min(p, q)
                out.append((x, y))
    return out
