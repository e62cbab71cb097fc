"""Sums of |x - y| / km over the pairs of two sets of places, without taking each pair by itself.

Places are halved into patches. Where two patches lie apart, and apart from each other's antipodes, where the distance has a
corner, 1 / km is a sum of some 10 to 45 products of a function of the one place and a function of the other: a cross
approximation, whose places are picked on a grid over each patch until what is left on the grids is below ``REST``. Summed over
values in order, |x - y| then costs a step per place instead of one per pair. Every pair is in the sum; a single one may be off by
some 1e-9 of itself, a sum by some 1e-12. Patches that touch, and small ones, are left to the caller.
"""

from __future__ import annotations

import numpy as np

from ..functions.fixed_values import EARTH_RADIUS_KM

LEAF_PLACES = 512
#: Places of the grid over a patch along each side, and the largest part of the largest entry that may be left on two grids.
GRID, REST = 10, 1e-10
#: Patches are apart if the gap between them is over so many times the larger one's radius, which is at most ``WIDEST`` radians.
APART, WIDEST = 0.8, 0.6
#: For fewer pairs than this the pairs themselves cost less.
LEAST_PAIRS = 1 << 16
#: Values of a run, of which running sums are taken.
RUN = 16


def unit_vectors(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    la, lo = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)], axis=1)


class Patch:
    """Places ``first`` up to ``last`` of a tile: corners of their box, a circle around them, and a grid over it."""

    def __init__(self, first: int, last: int, at: np.ndarray):
        self.first, self.last, self.kids = first, last, None
        self.low, self.high = at.min(axis=0), at.max(axis=0)
        middle = self.low + self.high
        length = np.linalg.norm(middle)
        self.grid, self.radius, self.centre = None, np.pi, None
        if length < 1e-3:
            return
        middle /= length
        if (at @ middle).min() < np.cos(WIDEST):
            return
        # The plane that touches the sphere in the middle: great circles are lines, so the circle around a box's corners holds the box.
        east = np.cross(middle, np.eye(3)[np.abs(middle).argmin()])
        east /= np.linalg.norm(east)
        axes = np.stack([east, np.cross(middle, east)])
        flat = (at @ axes.T) / (at @ middle)[:, None]
        mid, half = (flat.min(axis=0) + flat.max(axis=0)) / 2, np.ptp(flat, axis=0) / 2

        def lifted(steps: np.ndarray) -> np.ndarray:
            up = middle + (mid + half * steps) @ axes
            return up / np.linalg.norm(up, axis=1)[:, None]

        self.centre = lifted(np.zeros((1, 2)))[0]
        corners = lifted(np.array([[-1.0, -1.0], [-1.0, 1.0], [1.0, -1.0], [1.0, 1.0]]))
        self.radius = angle(np.linalg.norm(corners - self.centre, axis=1).max())
        steps = np.cos((2 * np.arange(GRID) + 1) * np.pi / (2 * GRID))
        self.grid = lifted(np.stack([np.repeat(steps, GRID), np.tile(steps, GRID)], axis=1))

    def __len__(self) -> int:
        return self.last - self.first


def angle(chord: float) -> float:
    return float(2 * np.arcsin(min(1.0, chord / 2)))


class Patches:
    """The places of a tile in an ``order`` in which every patch is a range; ``nodes[0]`` has them all."""

    def __init__(self, lat: np.ndarray, lon: np.ndarray, leaf: int = LEAF_PLACES):
        at, order = unit_vectors(lat, lon), np.arange(len(lat))
        self.nodes: list[Patch] = []
        todo = [(0, len(order), None)]
        while todo:
            first, last, parent = todo.pop()
            here = Patch(first, last, at[order[first:last]])
            if parent is not None:
                parent.kids = (*(parent.kids or ()), len(self.nodes))
            self.nodes.append(here)
            if last - first > leaf:
                own, mid = order[first:last], (first + last) // 2
                order[first:last] = own[np.argpartition(at[own, int((here.high - here.low).argmax())], mid - first)]
                todo += [(first, mid, here), (mid, last, here)]
        self.order, self.lat, self.lon, self.at = order, lat[order], lon[order], at[order]

    def __len__(self) -> int:
        return len(self.order)


def apart(u: Patch, v: Patch) -> bool:
    if u.grid is None or v.grid is None:
        return False
    between, both = angle(float(np.linalg.norm(u.centre - v.centre))), u.radius + v.radius
    return min(between, np.pi - between) - both > APART * max(u.radius, v.radius)


def split(u: Patch, v: Patch) -> bool | None:
    """Whether the first of two patches is to be halved rather than the second; None if neither can be."""
    if u.kids is None and v.kids is None:
        return None
    return v.kids is None or (u.kids is not None and (u.radius, len(u)) >= (v.radius, len(v)))


def per_km(a: np.ndarray, b: np.ndarray, middle: np.ndarray) -> np.ndarray:
    """1 / km of every pair of unit vectors, taken relative to a place near them, so that little cancels."""
    a, b = a - middle, b - middle
    h = (a * -0.5) @ b.T
    h += 0.25 * (a * a).sum(axis=1)[:, None]
    h += 0.25 * (b * b).sum(axis=1)[None, :]
    np.clip(h, 1e-30, 1.0, out=h)
    np.sqrt(h, out=h)
    np.arcsin(h, out=h)
    return np.divide(0.5 / EARTH_RADIUS_KM, h, out=h)


def crossing(k: np.ndarray) -> tuple[list[int], list[int], np.ndarray, np.ndarray]:
    """Rows and columns of a matrix whose cross approximation leaves less than ``REST`` of its largest entry anywhere, and the
    triangular factors of the square where they meet."""
    rest, rows, cols, left, right = k.copy(), [], [], [], []
    least = REST * float(np.abs(k).max())
    for _ in range(min(k.shape)):
        i, j = divmod(int(np.abs(rest).argmax()), k.shape[1])
        if abs(rest[i, j]) <= least:
            break
        rows.append(i)
        cols.append(j)
        left.append(rest[:, j] / rest[i, j])
        right.append(rest[i].copy())
        rest -= left[-1][:, None] * right[-1]
    return rows, cols, np.tril(np.array(left)[:, rows].T), np.triu(np.array(right)[:, cols])


def factors(u: Patch, v: Patch, at_u: np.ndarray, at_v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(f, g): f @ g.T is 1 / km of every place of ``u`` with every place of ``v``."""
    middle = (u.centre + v.centre) / 2
    rows, cols, lower, upper = crossing(per_km(u.grid, v.grid, middle))
    f, g = per_km(at_u, v.grid[cols], middle), per_km(at_v, u.grid[rows], middle)
    return f @ np.linalg.inv(upper), g @ np.linalg.inv(lower).T


def weighted_gaps(x: np.ndarray, i: np.ndarray, f: np.ndarray, y: np.ndarray, j: np.ndarray, g: np.ndarray) -> float:
    """The sum of |x - y| (f . g) over all pairs of x, with the rows ``i`` of f, and y, with the rows ``j`` of g; both ascend.

    ``below`` has the sums of g over the values up to each y, ``moment`` those of y g: first over runs of values, all runs at once.
    """
    if not len(x) or not len(y):
        return 0.0
    low = min(x[0], y[0])
    x, y, f = x - low, y - low, f.take(i, axis=0)
    runs = -(-len(y) // RUN)
    spare = runs * RUN - len(y)
    dealt = np.pad(j, (0, spare)).reshape(runs, RUN).T
    below = g.take(dealt, axis=0)
    below[RUN - spare :, -1] = 0.0
    moment = below * np.pad(y, (0, spare)).reshape(runs, RUN).T[:, :, None]
    for sums in (below, moment):
        for step in range(1, RUN):
            sums[step] += sums[step - 1]
        sums[:, 1:] += np.cumsum(sums[-1, :-1], axis=0)
    at = np.searchsorted(y, x)
    some = int(np.searchsorted(at, 1))
    row = (at[some:] - 1) % RUN * runs + (at[some:] - 1) // RUN
    below, moment = (sums.reshape(-1, g.shape[1]) for sums in (below, moment))
    over = float(x[some:] @ np.einsum("ik,ik->i", f[some:], below.take(row, axis=0))) - float(np.vdot(f[some:], moment.take(row, axis=0)))
    return 2 * over - float((x @ f) @ below[-1]) + float(f.sum(axis=0) @ moment[-1])
