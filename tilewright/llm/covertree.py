"""Cover trees over unit vectors, and the traversal of two trees that finds all close pairs."""

from __future__ import annotations

import numpy as np

SLACK = 1e-6  # distances come from dot products and are off by up to 1e-7; links themselves are decided by cosine
PAIRS = 1 << 15  # pairs of points whose vectors are gathered at a time


def _apart(dots: np.ndarray) -> np.ndarray:
    """Distance of unit vectors from their dot product."""
    return np.sqrt(np.maximum(2 - 2 * dots, 0))


class Tree:
    """Nodes of nested levels: a node's points lie within its covering radius of its centre, and
    the nodes of a level are nets of half the radius of the level above.

    ``order`` lists the points so that every node owns a run first..last of it."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.order = np.arange(len(points))
        self.centre, self.radius, self.first, self.last, self.kids = [], [], [], [], []
        self._grow(self._node(0, len(points)), 1.0)
        self.centre, self.radius = np.array(self.centre), np.array(self.radius)
        self.first, self.last = np.array(self.first), np.array(self.last)
        self.leaf = np.array([not k for k in self.kids], bool)
        self._below: dict[int, tuple] = {}

    def below(self, node: int) -> tuple[np.ndarray, np.ndarray]:
        """The children of a node and their centres' vectors."""
        if node not in self._below:
            kids = np.array(self.kids[node])
            self._below[node] = kids, self.points[self.centre[kids]]
        return self._below[node]

    def _node(self, first: int, last: int) -> int:
        own = self.points[self.order[first:last]]
        self.centre.append(int(self.order[first]))
        self.radius.append(float(_apart((own @ own[0]).min())) if last - first > 1 else 0.0)
        self.first.append(first)
        self.last.append(last)
        self.kids.append([])
        return len(self.centre) - 1

    def _grow(self, node: int, radius: float) -> None:
        todo = [(node, radius)]
        while todo:
            node, radius = todo.pop()
            first, last = self.first[node], self.last[node]
            if last - first == 1:
                continue
            while radius > self.radius[node] and radius > 1e-6:
                radius /= 2  # levels on which the node would be its own only child
            own = self.order[first:last].copy()
            vectors, left, at, runs = self.points[own], np.arange(last - first), first, []
            while len(left):  # the first point left is the next centre of the net
                if radius > 1e-6:
                    near = _apart(vectors[left] @ vectors[left[0]]) <= radius
                    near[0] = True
                else:
                    near = np.arange(len(left)) == 0
                n = int(near.sum())
                self.order[at : at + n] = own[left[near]]
                runs.append((at, at + n))
                left, at = left[~near], at + n
            for run in runs:
                child = self._node(*run)
                self.kids[node].append(child)
                todo.append((child, radius / 2))


def close_pairs(left: Tree, right: Tree | None, cosine: float, norms: tuple[np.ndarray, np.ndarray], raw: tuple[np.ndarray, np.ndarray]):
    """Yields (i, j) arrays: points of both trees (of ``left`` alone if right is None, i != j) whose cosine
    reaches ``cosine``, each pair once. ``raw`` and ``norms``: the vectors before they were scaled."""
    same = right is None
    right = left if same else right
    reach = float(np.sqrt(2 - 2 * cosine))
    a, b = np.array([0]), np.array([0])
    far = _apart(left.points[left.centre[a]] @ right.points[right.centre[0]])
    while len(a):
        bound = left.radius[a] + right.radius[b]
        near = far <= reach + bound + SLACK
        a, b, far, bound = a[near], b[near], far[near], bound[near]
        single = left.leaf[a] & right.leaf[b]
        whole = (far + bound <= reach - SLACK) & ~single  # every pair of these nodes is close
        for p, q in zip(a[whole].tolist(), b[whole].tolist()):
            i, j = left.order[left.first[p] : left.last[p]], right.order[right.first[q] : right.last[q]]
            if same and p == q:
                u, v = np.triu_indices(len(i), 1)
                yield i[u], i[v]
            else:
                yield np.repeat(i, len(j)), np.tile(j, len(i))
        ends = np.flatnonzero(single & ((a != b) if same else True))
        for low in range(0, len(ends), PAIRS):
            part = ends[low : low + PAIRS]
            i, j = left.centre[a[part]], right.centre[b[part]]
            close = np.einsum("ij,ij->i", raw[0][i], raw[1][j]) / (norms[0][i] * norms[1][j]) >= cosine
            yield i[close], j[close]
        open_pairs = np.flatnonzero(~single & ~whole)
        a, b = a[open_pairs], b[open_pairs]
        # the wider node is split; a node paired with itself gives each pair of its children once
        split_left = ~left.leaf[a] & (right.leaf[b] | (left.radius[a] >= right.radius[b]))
        new: list[tuple] = []
        for p, q, go_left in zip(a.tolist(), b.tolist(), split_left.tolist()):
            if same and p == q:
                kids, points = left.below(p)
                u, v = np.triu_indices(len(kids))
                dots, kids_a, kids_b = (points @ points.T)[u, v], kids[u], kids[v]
            elif go_left:
                kids_a, points = left.below(p)
                dots, kids_b = points @ right.points[right.centre[q]], np.full(len(kids_a), q)
            else:
                kids_b, points = right.below(q)
                dots, kids_a = points @ left.points[left.centre[p]], np.full(len(kids_b), p)
            away = _apart(dots)
            kept = away <= reach + left.radius[kids_a] + right.radius[kids_b] + SLACK
            if kept.any():
                new.append((kids_a[kept], kids_b[kept], away[kept]))
        if not new:
            return
        a, b, far = (np.concatenate(x) for x in zip(*new))
