"""The most correlated images of two blocks of images, in tiles, for use inside Arrow functions.

A tile of products is screened against what each image has found so far; what may be among its best is computed again
pair by pair, in one order of summing, so equal images tie. Blocks are in the order of their frames, so of equal
correlations the first seen is the one to keep, and later ones must be greater. Memory is that of two blocks and a few tiles.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

TILE, SEED = 1024, 256
#: Room for rounding errors of products.
SLACK = 1e-12


class Best:
    """The `most` best (corr, other) of n images so far, the best first; ties by the lesser `other`."""

    def __init__(self, n: int, most: int):
        self.most, self.corr, self.other = most, np.full((n, most), -np.inf), np.full((n, most), np.iinfo(np.int64).max)

    def add(self, rows: np.ndarray, others: np.ndarray, corr: np.ndarray) -> None:
        if not len(rows):
            return
        touched = np.unique(rows)
        rows = np.concatenate([np.repeat(touched, self.most), rows])
        others, corr = np.concatenate([self.other[touched].ravel(), others]), np.concatenate([self.corr[touched].ravel(), corr])
        order = np.lexsort((others, -corr, rows))
        take = order[np.searchsorted(rows[order], touched)[:, None] + np.arange(self.most)]
        self.corr[touched], self.other[touched] = corr[take], others[take]

    def found(self, frames: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        there = np.isfinite(self.corr)
        return np.repeat(frames, self.most)[there.ravel()], self.other[there], self.corr[there]


def cuts(n: int, tile: int = TILE, seed: int = SEED) -> list[slice]:
    """A few rows first, from which the first values to reach are taken."""
    edges = [0, *range(seed, n, tile), n] if n > seed else [0, n]
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def exact(d: np.ndarray, e: np.ndarray, i: np.ndarray, j: np.ndarray, p: np.ndarray, q: np.ndarray, digits: int) -> np.ndarray:
    """Correlations of listed pairs of rows of d and e, whose squared lengths are p and q."""
    out, step = np.empty(len(i)), max(1, 2**20 // max(1, d.shape[1]))
    for k in range(0, len(i), step):
        a, b = i[k : k + step], j[k : k + step]
        out[k : k + step] = np.einsum("ij,ij->i", d[a], e[b]) / (np.sqrt(p[a] * q[b]) + 1e-8)
    return np.round(out, digits)


def _open(dots: np.ndarray, s: np.ndarray, t: np.ndarray, best: np.ndarray, floor: np.ndarray, most: int, digits: int, axis: int) -> tuple[np.ndarray, np.ndarray]:
    """Where products of a tile (-inf: none), of images of lengths s and t, may be among the best of the images along `axis` (0: rows)."""
    unit = 10.0**-digits
    bound = np.maximum(best + 0.5 * unit - SLACK, floor)
    if np.isfinite(bound).all():
        lim = np.multiply.outer(s * bound, t) if axis == 0 else np.multiply.outer(s, t * bound)
        return np.nonzero(dots >= lim - 1e-8)
    corr = dots / (np.multiply.outer(s, t) + 1e-8)
    if axis:
        corr = corr.T
    if corr.shape[1] > most:
        bound = np.maximum(bound, np.partition(corr, -most, axis=1)[:, -most] - unit - SLACK)
    i, j = np.nonzero((corr >= bound[:, None]) & np.isfinite(corr))
    return (j, i) if axis else (i, j)


def best_of_blocks(
    one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray] | None, most: int, digits: int,
    wanted: Callable[[slice, slice], np.ndarray] | None = None, floors: tuple[np.ndarray, np.ndarray] | None = None,
) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], int]:
    """((frame, other, corr), pairs computed): of each image of two blocks (frames, deviations) the `most` best images of the other block, or of one block those in it.

    `wanted` says of a tile which pairs count, `floors` gives values that the best of an image reach anyway.
    """
    same = two is None
    sides = []
    for frames, dev in (one,) if same else (one, two):
        order = np.argsort(frames, kind="stable")
        sides.append((frames[order], dev[order], order))
    (f, d, fo), (g, e, go) = sides[0], sides[-1]
    p, q = (d * d).sum(1), (e * e).sum(1)
    s, t = np.sqrt(p), np.sqrt(q)
    low = [np.full(len(f), -np.inf), np.full(len(g), -np.inf)] if floors is None else [floors[0][fo] - 2 * 10.0**-digits, floors[1][go] - 2 * 10.0**-digits]
    a = Best(len(f), most)
    b = a if same else Best(len(g), most)
    computed = 0
    for r in cuts(len(f)):
        for c in cuts(len(g)):
            if same and c.start < r.start:
                continue
            inner = same and c.start == r.start
            want = None if wanted is None else wanted(fo[r], go[c])
            if same and f[r][-1] >= g[c][0]:
                apart = f[r][:, None] != g[c][None, :]
                want = apart if want is None else want & apart
            if want is not None:
                n = int(np.count_nonzero(want))
                computed += n // 2 if inner else n
                if not n:
                    continue
            else:
                computed += (r.stop - r.start) * (c.stop - c.start)
            if want is not None and n * 50 < want.size:
                i, j = np.nonzero(want)
                found = [(i, j), (i, j)]
            else:
                dots = d[r] @ e[c].T
                if want is not None:
                    dots[~want] = -np.inf
                found = [_open(dots, s[r], t[c], a.corr[r, -1], low[0][r], most, digits, 0)]
                found += [] if inner else [_open(dots, s[r], t[c], b.corr[c, -1], low[1][c], most, digits, 1)]
            i, j = found[0][0] + r.start, found[0][1] + c.start
            a.add(i, g[j], exact(d, e, i, j, p, q, digits))
            if not inner:
                i, j = found[1][0] + r.start, found[1][1] + c.start
                b.add(j, f[i], exact(d, e, i, j, p, q, digits))
    got = [a.found(f)] + ([] if same else [b.found(g)])
    return tuple(np.concatenate(x) for x in zip(*got, strict=True)), computed
