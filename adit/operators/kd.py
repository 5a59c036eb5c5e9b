"""A k-d split of space by counts: leaves of like size whatever the density, and nearest neighbours within and across them."""

import numpy as np


class Split:
    """Half-spaces that cut points at medians of their widest side, down to about ``leaf`` points each.

    Below the cut is left, from it on right. The outer leaves are open, so every place has a leaf.
    """

    def __init__(self, points: np.ndarray, leaf: int):
        self.axis, self.cut, self.child = [], [], []
        self.leaves = 0
        self._build(points, max(leaf, 1))
        self.axis, self.cut, self.child = np.array(self.axis, np.int64), np.array(self.cut, float), np.array(self.child, np.int64).reshape(-1, 2)

    def _build(self, points: np.ndarray, leaf: int) -> None:
        waiting = [(np.arange(len(points)), None)]
        while waiting:
            rows, at = waiting.pop()
            name = None
            if len(rows) > leaf:
                p = points[rows]
                axis = int(np.argmax(p.max(0) - p.min(0)))
                cut = float(np.median(p[:, axis]))
                below = p[:, axis] < cut
                if not below.any():  # half of them or more lie at the least place
                    above = p[:, axis][p[:, axis] > cut]
                    cut = float(above.min()) if len(above) else cut
                    below = p[:, axis] < cut
                if below.any() and not below.all():
                    name = len(self.axis)
                    self.axis.append(axis)
                    self.cut.append(cut)
                    self.child.append([0, 0])
                    waiting += [(rows[below], (name, 0)), (rows[~below], (name, 1))]
            if name is None:
                name = -1 - self.leaves
                self.leaves += 1
            if at:
                self.child[at[0]][at[1]] = name

    def leaf(self, q: np.ndarray) -> np.ndarray:
        """The leaf of each place."""
        node = np.full(len(q), 0 if len(self.axis) else -1, np.int64)
        rows = np.flatnonzero(node >= 0)
        while len(rows):
            n = node[rows]
            node[rows] = self.child[n, (q[rows, self.axis[n]] >= self.cut[n]).astype(int)]
            rows = rows[node[rows] >= 0]
        return -1 - node

    def touched(self, q: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of q, leaf) wherever the ball about a place reaches into a leaf's half-spaces."""
        rows, node, out = np.arange(len(q)), np.full(len(q), 0 if len(self.axis) else -1, np.int64), []
        while len(rows):
            end = node < 0
            out.append((rows[end], -1 - node[end]))
            rows, node = rows[~end], node[~end]
            x, r = q[rows, self.axis[node]], radius[rows]
            low, high = x - r <= self.cut[node], x + r >= self.cut[node]
            rows, node = np.concatenate([rows[low], rows[high]]), np.concatenate([self.child[node[low], 0], self.child[node[high], 1]])
        return (np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])) if out else (np.zeros(0, np.int64),) * 2


class _Blocks:
    """Points in blocks of one size, halved along the widest side again and again, all blocks of a level at once, and the boxes about the blocks of each level."""

    def __init__(self, p: np.ndarray, ids: np.ndarray, leaf: int):
        levels = 0
        while -(-len(p) // (1 << levels)) > leaf:
            levels += 1
        size = -(-len(p) // (1 << levels))
        x, rows = np.full((size << levels, 3), np.inf), np.full(size << levels, -1)  # places that no point fills lie at infinity
        x[: len(p)], rows[: len(p)] = p, np.arange(len(p))
        self.low, self.high = [], []
        for level in range(levels + 1):
            x, rows = x.reshape(1 << level, -1, 3), rows.reshape(1 << level, -1)
            self.low.append(x.min(1))
            self.high.append(np.where((rows >= 0)[:, :, None], x, -np.inf).max(1))
            if level < levels:
                axis = np.argmax(np.nan_to_num(self.high[-1] - self.low[-1], nan=-np.inf), 1)
                along = np.take_along_axis(x, axis[:, None, None], 2)[:, :, 0]
                order = np.argpartition(along, x.shape[1] // 2, axis=1)
                x, rows = np.take_along_axis(x, order[:, :, None], 1), np.take_along_axis(rows, order, 1)
        self.levels, self.size, self.x, self.ids = levels, size, [np.ascontiguousarray(x[:, :, c]) for c in range(3)], ids[rows]

    def away(self, level: int, q: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Squared distances of places from boxes; rounding makes none larger than that to a point within."""
        side = np.maximum(np.maximum(self.low[level][node] - q, q - self.high[level][node]), 0.0)
        return side[:, 0] ** 2 + side[:, 1] ** 2 + side[:, 2] ** 2


#: Places that are looked for together, and distances that are computed together.
PLACES, DISTANCES = 8192, 1 << 16


def nearest(q: np.ndarray, q_ids: np.ndarray, p: np.ndarray, p_ids: np.ndarray, k: int, leaf: int = 32, bound: np.ndarray | None = None) -> tuple[np.ndarray, int]:
    """The k smallest distances from each q to points of another id, infinite where there are fewer, and how many were computed.

    ``bound``: for each q a distance beyond which any of them may be missing. A place is compared with the block that it lies in or by, then with those
    that its ball reaches, the nearest first, while the ball shrinks.
    """
    best, made = np.full((len(q), k), np.inf), 0
    if not len(q) or not len(p):
        return best, made
    by = np.lexsort(p.T)
    new = np.append(True, (p[by[1:]] != p[by[:-1]]).any(1))
    nth = np.arange(len(p)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    few = np.sort(by[nth <= k])  # k + 1 copies of a place say all there is to say
    blocks = _Blocks(p[few], p_ids[few], max(leaf, 2 * k))
    most = np.full(len(q), np.inf) if bound is None else (bound * (1 + 1e-9)) ** 2

    def visit(rows: np.ndarray, at: np.ndarray) -> int:
        step = max(1, DISTANCES // blocks.size)
        for a in range(0, len(rows), step):
            own, there = rows[a : a + step], at[a : a + step]
            d = np.empty((len(own), k + blocks.size))
            d[:, :k] = best[own]
            far = (q[own, 0, None] - blocks.x[0][there]) ** 2
            for c in (1, 2):
                far += (q[own, c, None] - blocks.x[c][there]) ** 2
            d[:, k:] = np.where(q_ids[own, None] == blocks.ids[there], np.inf, far)
            d.partition(k - 1, axis=1)
            best[own] = d[:, :k]
            most[own] = np.fmin(most[own], d[:, k - 1])
        return len(rows) * blocks.size

    home = np.zeros(len(q), np.int64)
    for level in range(1, blocks.levels + 1):
        home *= 2
        home += blocks.away(level, q, home + 1) < blocks.away(level, q, home)
    order = np.argsort(home, kind="stable")
    for a in range(0, len(q), PLACES):
        rows = order[a : a + PLACES]
        rows = rows[blocks.away(blocks.levels, q[rows], home[rows]) <= most[rows]]
        made += visit(rows, home[rows])
        rows, node, away = order[a : a + PLACES], np.zeros(len(order[a : a + PLACES]), np.int64), None
        for level in range(1, blocks.levels + 1):
            rows, node = np.repeat(rows, 2), (2 * node[:, None] + np.arange(2)).ravel()
            away = blocks.away(level, q[rows], node)
            on = (away <= most[rows]) & (away < np.inf)
            rows, node, away = rows[on], node[on], away[on]
        if away is None:
            continue
        other = node != home[rows]
        rows, node, away = rows[other], node[other], away[other]
        by = np.lexsort((away, rows))
        rows, node, away = rows[by], node[by], away[by]
        start = np.append(True, rows[1:] != rows[:-1]) if len(rows) else np.zeros(0, bool)
        turn = np.arange(len(rows)) - np.flatnonzero(start)[np.cumsum(start) - 1]
        by = np.argsort(turn, kind="stable")
        for some in np.split(by, np.cumsum(np.bincount(turn))[:-1]) if len(by) else []:
            some = some[away[some] <= most[rows[some]]]
            made += visit(rows[some], node[some])
    return np.sqrt(best), made
