"""Signature trees: similarity self-join of a group of sets by dual traversal.

A leaf is a set with a bitmap of its hashed tokens; an inner node has the OR of
its children's bitmaps, the range of their sizes and their largest slack (size
minus bits set: tokens that may hide behind one bit).  For sets A below P and
B below Q, |A n B| <= least slack + bits common to both bitmaps, so a node pair
is pruned when its size ranges are too far apart or when this maximum possible
overlap is less than the least overlap that the threshold asks for.

Sets fall in size classes (a factor of 1 / threshold), one tree each; only
equal and neighbouring classes are traversed, with a bitmap width fit to them.
As components are asked for, node pairs whose sets are already linked together
are pruned too: a group of near copies costs about one check a member.
"""

from __future__ import annotations

import numpy as np

FANOUT = 16
BITS_PER_TOKEN = 4
STEP_WORDS = 1 << 21


def needed_overlap(a, b, percent: int):
    """Least |A n B| for 100 * |A n B| >= percent * |A u B| (sizes a, b)."""
    return -(-percent * (a + b) // (100 + percent))


class Level:
    def __init__(self, bits, lo, hi, slack, first):
        self.bits, self.lo, self.hi, self.slack, self.first = bits, lo, hi, slack, first


class Tree:
    """Levels from the sets (0) up to a few nodes; `ids` are set indices."""

    def __init__(self, ids: np.ndarray, sets: list[np.ndarray], width: int):
        self.ids = ids
        size = np.array([len(sets[i]) for i in ids], dtype=np.int64)
        flags = np.zeros((len(ids), width), dtype=np.uint8)
        row = np.repeat(np.arange(len(ids)), size)
        flags[row, (np.concatenate([sets[i] for i in ids]) & np.uint64(width - 1)).astype(np.int64)] = 1
        bits = np.packbits(flags, axis=1, bitorder="little").view(np.uint64)
        slack = size - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.levels = [Level(bits, size, size, slack, np.arange(len(ids)))]
        while len(self.levels[-1].lo) > FANOUT:
            d = self.levels[-1]
            cut = np.arange(0, len(d.lo), FANOUT)
            self.levels.append(Level(np.bitwise_or.reduceat(d.bits, cut, axis=0), np.minimum.reduceat(d.lo, cut),
                                     np.maximum.reduceat(d.hi, cut), np.maximum.reduceat(d.slack, cut), d.first[cut]))


class Linker:
    """Links the sets of one group; `label` is the component of each set."""

    def __init__(self, sets: list[np.ndarray], side: np.ndarray | None, percent: int):
        self.sets, self.side, self.percent = sets, side, percent
        self.label = np.arange(len(sets))
        self.members = [[i] for i in range(len(sets))]
        self.merges = 0

    def check(self, i: int, j: int) -> None:
        a, b = self.sets[i], self.sets[j]
        need = needed_overlap(len(a), len(b), self.percent)
        if min(len(a), len(b)) < need:
            return
        both = np.sort(np.concatenate([a, b]), kind="stable")
        if int((both[1:] == both[:-1]).sum()) >= need:
            x, y = int(self.label[i]), int(self.label[j])
            if len(self.members[x]) < len(self.members[y]):
                x, y = y, x
            self.label[self.members[y]] = x
            self.members[x] += self.members[y]
            self.members[y] = []
            self.merges += 1

    def check_all(self, i: np.ndarray, j: np.ndarray) -> None:
        """Check pairs, leaving out those that have become linked meanwhile."""
        while len(i):
            open_ = self.label[i] != self.label[j]
            i, j = i[open_], j[open_]
            for a, b in zip(i[:64].tolist(), j[:64].tolist(), strict=True):
                if self.label[a] != self.label[b]:
                    self.check(a, b)
            i, j = i[64:], j[64:]

    def run(self) -> np.ndarray:
        """Component label of each set."""
        size = np.array([len(s) for s in self.sets], dtype=np.int64)
        ratio = 100 / self.percent
        cls = np.floor(np.log(size) / np.log(ratio) + 1e-9).astype(np.int64)
        low = np.array([[int(s[0]), int(s[min(1, len(s) - 1)])] for s in self.sets], dtype=np.uint64)
        order = np.lexsort((low[:, 1], low[:, 0], cls))
        groups = np.split(order, np.flatnonzero(np.diff(cls[order])) + 1)
        trees: dict[tuple[int, int], Tree] = {}

        def tree(g: np.ndarray, width: int) -> Tree:
            key = (int(g[0]), width)
            if key not in trees:
                trees[key] = Tree(g, self.sets, width)
            return trees[key]

        for k, g in enumerate(groups):
            # Neighbours in min-hash order first: near copies link up here.
            self.check_all(g[1:], g[:-1])
            near = [g]
            if k and cls[groups[k - 1][0]] + 1 == cls[g[0]]:
                near.append(groups[k - 1])
            width = 64
            while width < BITS_PER_TOKEN * size[g].max() and width < 1 << 16:
                width *= 2
            own = tree(g, width)
            for other in near:
                self.traverse(own, own if other is g else tree(other, width))
            trees = {key: t for key, t in trees.items() if key[0] == int(g[0])}
        return self.label

    def _uniform(self, t: Tree) -> list[np.ndarray]:
        """Per level: the common component of each node's sets, or -1."""
        lab = self.label[t.ids]
        out = [lab]
        for _ in t.levels[1:]:
            cut = np.arange(0, len(out[-1]), FANOUT)
            lo, hi = np.minimum.reduceat(out[-1], cut), np.maximum.reduceat(out[-1], cut)
            out.append(np.where(lo == hi, lo, -1))
        return out

    def traverse(self, p: Tree, q: Tree) -> None:
        same = p is q
        top = max(len(p.levels), len(q.levels)) - 1
        i, j = np.meshgrid(np.arange(len(p.levels[-1].lo)), np.arange(len(q.levels[-1].lo)), indexing="ij")
        i, j = i.ravel(), j.ravel()
        if same:
            i, j = i[i <= j], j[i <= j]
        stack = [(min(top, len(p.levels) - 1), min(top, len(q.levels) - 1), i, j)]
        seen, up, uq = -1, None, None
        words = p.levels[0].bits.shape[1]
        room = max(FANOUT * FANOUT, STEP_WORDS // words)
        while stack:
            a, b, i, j = stack.pop()
            if len(i) > room:
                stack.append((a, b, i[room:], j[room:]))
                i, j = i[:room], j[:room]
            if self.merges != seen:
                seen, up, uq = self.merges, self._uniform(p), self._uniform(q)
            x, y = p.levels[a], q.levels[b]
            keep = (up[a][i] < 0) | (up[a][i] != uq[b][j])
            keep &= (100 * x.hi[i] >= self.percent * y.lo[j]) & (100 * y.hi[j] >= self.percent * x.lo[i])
            if same and a == b == 0:
                keep &= i < j
            i, j = i[keep], j[keep]
            if self.side is not None and a == b == 0:
                cross = self.side[p.ids[i]] != self.side[q.ids[j]]
                i, j = i[cross], j[cross]
            if len(i) == 0:
                continue
            most = (np.minimum(x.slack[i], y.slack[j])
                    + np.bitwise_count(x.bits[i] & y.bits[j]).sum(axis=1, dtype=np.int64))
            keep = most >= needed_overlap(x.lo[i], y.lo[j], self.percent)
            i, j = i[keep], j[keep]
            if len(i) == 0:
                continue
            if a == b == 0:
                self.check_all(p.ids[i], q.ids[j])
                continue
            down_a, down_b = a >= b, b >= a
            na = len(p.levels[a - 1].lo) if down_a else 0
            nb = len(q.levels[b - 1].lo) if down_b else 0
            step = np.arange(FANOUT)
            fa = (i[:, None] * FANOUT + step) if down_a else i[:, None]
            fb = (j[:, None] * FANOUT + step) if down_b else j[:, None]
            ci = np.repeat(fa, fb.shape[1], axis=1).ravel()
            cj = np.tile(fb, (1, fa.shape[1])).ravel()
            ok = np.ones(len(ci), dtype=bool)
            if down_a:
                ok &= ci < na
            if down_b:
                ok &= cj < nb
            if same:
                ok &= ci <= cj
            a, b = a - down_a, b - down_b
            ci, cj = ci[ok], cj[ok]
            for k in range(0, len(ci), room):
                stack.append((a, b, ci[k:k + room], cj[k:k + room]))


def link_components(sets: list[np.ndarray], side: np.ndarray | None = None, percent: int = 80) -> np.ndarray:
    """Components of sets (sorted distinct uint64) linked at `percent` per cent
    Jaccard similarity; with `side`, all pairs across sides are compared (pairs
    of one side may be linked on the way, which another task checks too)."""
    if len(sets) < 2:
        return np.arange(len(sets))
    return Linker(sets, side, percent).run()
