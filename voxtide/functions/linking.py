"""Linking particle positions of successive frames into tracks (Crocker and Grier's rule), for one sequence at a time.

`Linker` keeps the tracks that may go on. A frame's positions are bonded to these where they lie closer than
`maxdisp`; a bond that is the only one at both ends is taken; the rest fall apart into subnetworks, each of which gets
the assignment with the least sum of squared displacements, where a track without a partner costs maxdisp squared.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import islice

import numpy as np

#: A subnetwork with more possible assignments than this is solved as an assignment problem instead of by search.
SEARCH_LIMIT = 200_000


#: Rows that are bonded together.
TOGETHER = 2**18


def _cells(points: np.ndarray, radius: float, low: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """The number of the grid cell of each point."""
    key = np.zeros(len(points), np.int64)
    for axis, step in enumerate(scale.tolist()):
        key += (np.floor(points[:, axis] / radius).astype(np.int64) - low[axis]) * step
    return key


def bonds(a: np.ndarray, b: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j, squared distance) of rows of a and b less than `radius` apart, through a grid of that size.

    Three cells that follow each other on the first axis have numbers that do so; both sides are taken in the order of
    their cells, as places that lie together are found faster, and some rows of a at a time.
    """
    none = np.zeros(0, np.int64)
    if not len(a) or not len(b):
        return none, none, np.zeros(0)
    if not (np.isfinite(a).all() and np.isfinite(b).all()):
        # what has no place is near nothing
        ia, ib = (np.flatnonzero(np.isfinite(p).all(1)) for p in (a, b))
        i, j, d2 = bonds(a[ia], b[ib], radius)
        return ia[i], ib[j], d2
    dim = a.shape[1]
    least = np.floor(np.minimum(a.min(0), b.min(0)) / radius).astype(np.int64)
    most = np.floor(np.maximum(a.max(0), b.max(0)) / radius).astype(np.int64)
    low, span = least - 1, most - least + 3
    scale = np.cumprod(np.concatenate([[1], span[:-1]]))
    ka, kb = _cells(a, radius, low, scale), _cells(b, radius, low, scale)
    order_a, order_b = np.argsort(ka, kind="stable"), np.argsort(kb, kind="stable")
    keys, b_sorted = kb[order_b], b[order_b]
    moves = [int((np.array(move, np.int64) - 1) @ scale[1:]) for move in np.ndindex(*([3] * (dim - 1)))]
    out_i, out_j, out_d = [none], [none], [np.zeros(0)]
    for start in range(0, len(a), TOGETHER):
        rows = order_a[start : start + TOGETHER]
        key, here = ka[rows], a[rows]
        for move in moves:
            lo, hi = np.searchsorted(keys, key + (move - 1), "left"), np.searchsorted(keys, key + (move + 1), "right")
            n = hi - lo
            i = np.repeat(np.arange(len(rows)), n)
            at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(len(i))
            d2 = ((here[i] - b_sorted[at]) ** 2).sum(1)
            ok = d2 < radius * radius
            out_i.append(rows[i[ok]])
            out_j.append(order_b[at[ok]])
            out_d.append(d2[ok])
    i, j, d2 = np.concatenate(out_i), np.concatenate(out_j), np.concatenate(out_d)
    by = np.lexsort((j, i))
    return i[by], j[by], d2[by]


def best_assignment(rows: list[list[tuple[int, float]]], lost: float) -> list[int]:
    """For each row the chosen column or -1, with the least total cost; equal totals go to the lowest columns first."""
    if len(rows) == 1:
        return [min(rows[0], key=lambda c: (c[1], c[0]))[0]]
    combos = 1
    for r in rows:
        combos *= len(r) + 1
    if combos > SEARCH_LIMIT:
        return hungarian(rows, lost)
    options = [sorted(r, key=lambda c: (c[1], c[0])) for r in rows]
    least = [min(min((c[1] for c in r), default=lost), lost) for r in options]
    rest = np.cumsum(least[::-1])[::-1].tolist() + [0.0]
    best, choice = [np.inf], [[-1] * len(rows)]
    now = [-1] * len(rows)

    def search(k: int, used: set[int], cost: float) -> None:
        if cost + rest[k] >= best[0] - 1e-12:
            return
        if k == len(rows):
            best[0], choice[0] = cost, now.copy()
            return
        for col, d in options[k]:
            if col not in used:
                now[k] = col
                search(k + 1, used | {col}, cost + d)
        now[k] = -1
        search(k + 1, used, cost + lost)

    search(0, set(), 0.0)
    return choice[0]


def hungarian(rows: list[list[tuple[int, float]]], lost: float) -> list[int]:
    """The same by shortest augmenting paths, in cubic time."""
    cols = sorted({c for r in rows for c, _ in r})
    at = {c: i for i, c in enumerate(cols)}
    n, m = len(rows), len(cols) + len(rows)
    cost = np.full((n, m), lost)
    cost[:, : len(cols)] = 4 * lost * (n + 1)
    for i, r in enumerate(rows):
        for c, d in r:
            cost[i, at[c]] = d
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    match, way = np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        low, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0 = match[j0]
            free = ~used[1:]
            cur = cost[i0 - 1] - u[i0] - v[1:]
            better = free & (cur < low[1:])
            low[1:][better] = cur[better]
            way[1:][better] = j0
            j1 = int(np.where(free, low[1:], np.inf).argmin()) + 1
            step = low[j1]
            u[match[used]] += step
            v[used] -= step
            low[~used] -= step
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    out = [-1] * n
    for j in range(1, len(cols) + 1):
        if match[j]:
            out[match[j] - 1] = cols[j - 1]
    return out


def subnetworks(i: np.ndarray, j: np.ndarray) -> list[np.ndarray]:
    """Indices of bonds, by connected component of the graph they make."""
    label = np.arange(len(i))
    ends = [np.unique(side, return_inverse=True)[1] for side in (i, j)]
    while True:
        new = label
        for end in ends:
            least = np.full(end.max() + 1, len(i))
            np.minimum.at(least, end, new)
            new = least[end]
        if (new == label).all():
            break
        label = new
    order = np.argsort(label, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(label[order])) + 1)


@dataclass
class Linker:
    maxdisp: float
    mem: int
    dim: int
    next_id: int = 0
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    at: np.ndarray | None = None
    age: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def add(self, positions: np.ndarray) -> np.ndarray:
        """The track of each position of the next frame."""
        positions = np.asarray(positions, float)[:, : self.dim]
        n = len(positions)
        track = np.full(n, -1, np.int64)
        if self.at is None:
            self.at = np.zeros((0, positions.shape[1]))
        i, j, d2 = bonds(self.at, positions, self.maxdisp)
        taken = np.full(len(self.ids), -1, np.int64)
        if len(i):
            lone = (np.bincount(i)[i] == 1) & (np.bincount(j)[j] == 1)
            taken[i[lone]] = j[lone]
            i, j, d2 = i[~lone], j[~lone], d2[~lone]
            nets = subnetworks(i, j) if len(i) else []
            order = np.concatenate(nets) if nets else i
            ends = zip(i[order].tolist(), j[order].tolist(), d2[order].tolist(), strict=True)
            for net in nets:
                # bonds come by track
                options: dict[int, list[tuple[int, float]]] = {}
                for r, c, d in islice(ends, len(net)):
                    options.setdefault(r, []).append((c, d))
                for r, c in zip(options, best_assignment(list(options.values()), self.maxdisp**2), strict=True):
                    taken[r] = c
        hit = taken >= 0
        track[taken[hit]] = self.ids[hit]
        self.at[hit] = positions[taken[hit]]
        self.age = np.where(hit, 0, self.age + 1)
        alive = self.age <= self.mem
        new = np.flatnonzero(track < 0)
        track[new] = self.next_id + np.arange(len(new))
        self.next_id += len(new)
        self.ids = np.concatenate([self.ids[alive], track[new]])
        self.at = np.concatenate([self.at[alive], positions[new]])
        self.age = np.concatenate([self.age[alive], np.zeros(len(new), np.int64)])
        return track


def track(frame: np.ndarray, positions: np.ndarray, maxdisp: float, mem: int, good: int, dim: int) -> np.ndarray:
    """Track numbers 1, 2, ... (by first frame, then input order there), 0 for observations of tracks that are too short. Frames are the distinct values present."""
    order = np.argsort(frame, kind="stable")
    linker, out = Linker(maxdisp, mem, dim), np.zeros(len(frame), np.int64)
    if len(np.unique(frame)) < 2:
        return out
    for part in np.split(order, np.flatnonzero(np.diff(frame[order])) + 1):
        out[part] = linker.add(positions[part])
    count = np.bincount(out)
    keep = np.flatnonzero(count >= good)
    number = np.zeros(len(count), np.int64)
    number[keep] = np.arange(1, len(keep) + 1)
    return number[out]
