"""A cover tree over integer vectors that answers windows of inner products exactly."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa

LEAF = 64  # rows below which a node is not split
CHILDREN = 32  # of a node
EXACT = 2.0**52  # below it sums of products are exact in double precision
LOWEST = -(2**62)
HIGHEST = 2**62


def matrix(lists: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Integer vectors as rows; components that are missing count as zero."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], lists.type)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(flat) == len(sizes) * dim and (sizes == dim).all():
        return flat.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim), np.int64)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), at] = flat
    return out


def augmented(rows: np.ndarray, top: float) -> np.ndarray:
    """One more component, so that every row has the norm `top` (the largest there is). Inner
    products with queries, whose last component is zero, stay the same."""
    rows = rows.astype(np.float64)
    rest = np.maximum(top * top - np.einsum("ij,ij->i", rows, rows), 0.0)
    return np.column_stack([rows, np.sqrt(rest)])


def angles(products: np.ndarray, scale: float | np.ndarray) -> np.ndarray:
    """Angles of vectors from their inner products and the products of their norms."""
    return np.arccos(np.clip(products / np.where(scale == 0, 1.0, scale), -1.0, 1.0))


def bounds(products: np.ndarray, radius, scale) -> tuple[np.ndarray, np.ndarray]:
    """(highest, lowest) inner product of a query with anything within `radius` of centres
    with the given inner products. A little slack covers rounding."""
    at = angles(products, scale)
    slack = 1e-7 * scale + 1e-3
    high = scale * np.cos(np.maximum(at - radius, 0.0)) + slack
    return high, scale * np.cos(np.minimum(at + radius, np.pi)) - slack


def farthest_first(points: np.ndarray, top: float, most: int, enough: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres (row numbers), each row's nearest centre, and its angle to it: the next centre
    is the row farthest from all centres so far, until all are within `enough`."""
    scale = top * top
    centres = [0]
    nearest = np.zeros(len(points), np.int64)
    away = angles(points @ points[0], scale)
    away[0] = 0.0
    while len(centres) < most:
        far = int(np.argmax(away))
        if away[far] <= enough:
            break
        new = angles(points @ points[far], scale)
        new[far] = 0.0
        closer = new < away
        nearest[closer] = len(centres)
        away[closer] = new[closer]
        centres.append(far)
    return np.array(centres), nearest, away


class CoverTree:
    """Nodes in breadth-first order, the children of a node next to each other. A child's
    centre is a row; all rows below a node are within its covering angle. Children of a level
    lie apart by more than half the angle above them and cover it, unless 32 do not suffice
    for that: then they are the 32 farthest-first ones, with the angles they do cover."""

    def __init__(self, rows: np.ndarray, top: float):
        self.top = top
        points = augmented(rows, top)
        order, centres, radii, first, last, begin, end = [], [], [], [], [], [], []
        root = np.arange(len(rows))
        away = angles(points @ points[0], top * top) if len(rows) else np.zeros(0)
        waiting = [(root, float(away.max(initial=0.0)))]
        centres.append(0)
        radii.append(waiting[0][1])
        at = 0
        while at < len(waiting):
            members, radius = waiting[at]
            waiting[at] = None
            at += 1
            if len(members) <= LEAF or radius == 0.0:
                first.append(0)
                last.append(0)
                begin.append(len(order))
                order.extend(members.tolist())
                end.append(len(order))
                continue
            picked, nearest, apart = farthest_first(points[members], top, CHILDREN, radius / 2)
            first.append(len(waiting))
            for k, c in enumerate(picked):
                mine = nearest == k
                reach = float(apart[mine].max(initial=0.0))
                mine[c] = False
                below = np.concatenate([members[c : c + 1], members[mine]])  # its centre first
                # A child that holds all of its parent is not taken apart further.
                waiting.append((below, reach if len(below) < len(members) else 0.0))
                centres.append(int(members[c]))
                radii.append(reach)
            last.append(len(waiting))
            begin.append(0)
            end.append(0)
        self.order = np.array(order, np.int64)
        self.centres = rows[centres].astype(np.float64) if len(rows) else np.zeros((1, rows.shape[1]))
        self.radii = np.array(radii)
        self.first, self.last, self.begin, self.end = first, last, begin, end
        exact = top * top < EXACT
        self.rows = rows[self.order].astype(np.float64) if exact else rows[self.order]


class Windows:
    """Windows low..high of scores of many queries (rows: queries, columns: windows), what each
    still wants, and the best `k` hits found so far."""

    def __init__(self, low: np.ndarray, high: np.ndarray, need: np.ndarray, k: int):
        self.tops, self.k = high, k
        self.wants = np.maximum(low, need)
        self.wants[self.wants > self.tops] = HIGHEST  # an empty window
        self.tops = np.where(self.wants == HIGHEST, LOWEST, self.tops)
        none = np.zeros(0, np.int64)
        # (query, window, score, id) of hits
        self.found: list[tuple[np.ndarray, ...]] = [(none, none, none, none)]
        self.waiting = 0

    def open_to(self, queries: np.ndarray, up: np.ndarray, down: np.ndarray) -> np.ndarray:
        """Which of the queries want something with scores between `down` and `up`."""
        hit = (up[:, None] >= self.wants[queries]) & (down[:, None] <= self.tops[queries])
        return hit.any(axis=1)

    def add(self, queries: np.ndarray, scores: np.ndarray, allowed: np.ndarray, ids: "Ids", begin: int, own: np.ndarray) -> None:
        """Scores of the rows from `begin` on, a line per query."""
        least, most = self.wants[queries], self.tops[queries]
        for w in range(least.shape[1]):
            hit = (scores >= least[:, w, None]) & (scores <= most[:, w, None]) & allowed
            at, row = np.nonzero(hit)
            if not len(at):
                continue
            many, found = ids.of(begin + row)
            q = np.repeat(queries[at], many)
            s = np.repeat(scores[at, row], many).astype(np.int64)
            other = found != own[q]
            self.found.append((q[other], np.full(int(other.sum()), w), s[other], found[other]))
            self.waiting += len(at)
        if self.waiting > 8 * self.k * self.wants.shape[0]:
            self.settle()

    def settle(self) -> tuple[np.ndarray, ...]:
        """Keep the first `k` hits of each window, higher scores first, then smaller ids; a
        full window wants nothing below them."""
        q, w, s, x = (np.concatenate(c) for c in zip(*self.found))
        order = np.lexsort((x, -s, w, q))
        q, w, s, x = q[order], w[order], s[order], x[order]
        group = q * self.wants.shape[1] + w
        new = np.flatnonzero(np.diff(group, prepend=-1))
        rank = np.arange(len(q)) - np.repeat(new, np.diff(np.append(new, len(q))))
        full = rank == self.k - 1
        self.wants[q[full], w[full]] = np.maximum(self.wants[q[full], w[full]], s[full])
        kept = rank < self.k
        self.found, self.waiting = [(q[kept], w[kept], s[kept], x[kept])], 0
        return self.found[0]


class Ids:
    """The ids that each row stands for, in the tree's order of rows."""

    def __init__(self, lists: list[list[int]]):
        self.sizes = np.array([len(x) for x in lists], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.flat = np.array([x for ids in lists for x in ids], np.int64)

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each row, the ids one after the other)."""
        many = self.sizes[rows]
        begin = self.ends[rows] - many
        shift = begin - (np.cumsum(many) - many)
        return many, self.flat[np.arange(many.sum()) + np.repeat(shift, many)]


def search(
    tree: CoverTree, queries: np.ndarray, own: np.ndarray, allowed: np.ndarray, ids: Ids, windows: Windows
) -> tuple[np.ndarray, ...]:
    """(query, window, score, id) of the first `k` rows in each window, among the allowed rows
    (`allowed`: a line per query, rows in the tree's order) but the query's `own` id.

    Nodes are visited best bound first, for all queries at once that want something of them:
    those whose bounds miss every window, or what a window still wants, leave, and a node
    without queries is skipped with all below it. Leaves are verified exactly.
    """
    exact = tree.rows.dtype == np.float64
    floats = queries.astype(np.float64)
    scale = np.sqrt(np.einsum("ij,ij->i", floats, floats)) * tree.top
    asked = floats if exact else queries
    everyone = np.arange(len(queries))
    up, down = bounds(floats @ tree.centres[0], tree.radii[0], scale)
    heap = [(-float(up.max(initial=0.0)), 0, everyone, up, down)]
    while heap:
        _, node, who, up, down = heapq.heappop(heap)
        alive = windows.open_to(who, up, down)
        if not alive.any():
            continue
        who = who[alive]
        if not tree.last[node]:
            begin, end = tree.begin[node], tree.end[node]
            scores = asked[who] @ tree.rows[begin:end].T
            windows.add(who, scores, allowed[who, begin:end], ids, begin, own)
            continue
        a, b = tree.first[node], tree.last[node]
        ups, downs = bounds(floats[who] @ tree.centres[a:b].T, tree.radii[a:b], scale[who][:, None])
        for i in range(b - a):
            some = windows.open_to(who, ups[:, i], downs[:, i])
            if some.any():
                best = -float(ups[some, i].max())
                heapq.heappush(heap, (best, a + i, who[some], ups[some, i], downs[some, i]))
    return windows.settle()
