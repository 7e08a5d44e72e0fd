"""Total-variation denoising of volumes in blocks that exchange their borders.

A volume is cut into blocks, a row each, whatever the volume's size; the dual variables of the denoising are part of the
row and so are written with it between exchanges. Before `together` steps each block gets its surroundings, `together` + 1
cells wide, from the blocks that have them (periodic, as the differences are); a step spoils one cell of that border on
each side, so the block itself comes out as it would in the whole volume. An exchange is one shuffle of the blocks and
their borders, and a task holds one block with its border. The same steps give planes (axes y, x), volumes (all axes), the
z axis alone, or planes and z in turns.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.solvers import differences, divergence
from ..tables import materialize, ship

#: Cells of a block along z, y and x.
BLOCK = (32, 64, 64)
AXES = {"planes": (1, 2), "volume": (0, 1, 2), "z": (0,)}
_BLOCKS = "frame long, bz int, by int, bx int, data binary"


def extents(size: tuple[int, int, int], block: tuple[int, int, int]) -> list[list[tuple[int, int]]]:
    """First cell and the one after the last of the blocks along each axis."""
    return [[(a, min(a + b, n)) for a in range(0, n, b)] for n, b in zip(size, block, strict=True)]


def shares(parts: list[tuple[int, int]], n: int, own: int, border: int, periodic: bool = True) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Along one axis, which blocks need cells of block `own`: (block, places in it with its border, cells of `own`)."""
    lo, hi = parts[own]
    out = []
    for t, (a, b) in enumerate(parts):
        at = np.arange(a - border, b + border)
        at = at % n if periodic else at
        places = np.flatnonzero((at >= lo) & (at < hi))
        if len(places):
            out.append((t, places, at[places] - lo))
    return out


def to_blocks(voxels: DataFrame, w: int, h: int, d: int, block: tuple[int, int, int] = BLOCK) -> DataFrame:
    """(frame, bz, by, bx, data): real and imaginary parts of every block of the frames, zero where there is no voxel."""
    ship(voxels.sparkSession)
    parts = extents((d, h, w), block)
    at = {f"b{a}": F.floor(F.col(a) / b).cast("int") for a, b in zip("zyx", block, strict=True)}
    inside = voxels.filter(F.col("z").between(0, d - 1) & F.col("y").between(0, h - 1) & F.col("x").between(0, w - 1))
    cells = inside.select(F.col("frame").cast("long").alias("frame"), *[F.col(a).cast("int").alias(a) for a in "zyx"], "re", "im").withColumns(at)
    held = cells.groupBy("frame", *at).agg(F.collect_list(F.struct("z", "y", "x", "re", "im")).alias("cells"))
    every = cells.select("frame").distinct()
    for (name, _), p in zip(at.items(), parts, strict=True):
        every = every.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(len(p) - 1))))
    rows = every.join(held, ["frame", *at], "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for r in batch.itertuples():
                edge = [p[i] for p, i in zip(parts, (r.bz, r.by, r.bx), strict=True)]
                a = np.zeros((2, *(hi - lo for lo, hi in edge)))
                for c in r.cells if r.cells is not None else []:
                    a[:, c["z"] - edge[0][0], c["y"] - edge[1][0], c["x"] - edge[2][0]] = c["re"], c["im"]
                made.append(a.tobytes())
            yield batch[["frame", "bz", "by", "bx"]].assign(data=made)

    return rows.mapInPandas(run, _BLOCKS)


def from_blocks(blocks: DataFrame, w: int, h: int, d: int, block: tuple[int, int, int] = BLOCK) -> DataFrame:
    """The voxels (frame, z, y, x, re, im) of blocks that aren't zero."""
    parts = extents((d, h, w), block)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                edge = [p[i] for p, i in zip(parts, (r.bz, r.by, r.bx), strict=True)]
                a = np.frombuffer(r.data).reshape(-1, *(hi - lo for lo, hi in edge))[:2]
                z, y, x = np.nonzero((a != 0).any(0))
                yield pd.DataFrame({"frame": r.frame, "z": z + edge[0][0], "y": y + edge[1][0], "x": x + edge[2][0], "re": a[0, z, y, x], "im": a[1, z, y, x]})

    return blocks.mapInPandas(run, "frame long, z int, y int, x int, re double, im double")


def _exchanged(blocks: DataFrame, size: tuple[int, int, int], block: tuple[int, int, int], border: int, axes: tuple[int, ...], kernel, periodic: bool = True, outside: float = 0.0) -> DataFrame:
    """Blocks after `kernel` of each block's channels with a border along `axes`; the kernel's channels lose the border. Without `periodic`, what lies outside the volume is `outside`."""
    parts = extents(size, block)
    wide = [border if i in axes else 0 for i in range(3)]

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                own = (r.bz, r.by, r.bx)
                shape = [hi - lo for lo, hi in (p[i] for p, i in zip(parts, own, strict=True))]
                a = np.frombuffer(r.data).reshape(-1, *shape)
                out = []
                for (tz, pz, sz), (ty, py, sy), (tx, px, sx) in product(*(shares(p, n, i, k, periodic) for p, n, i, k in zip(parts, size, own, wide, strict=True))):
                    out.append((r.frame, tz, ty, tx, pz.astype(np.int32), py.astype(np.int32), px.astype(np.int32), a[:, sz[:, None, None], sy[:, None], sx].tobytes()))
                yield pd.DataFrame(out, columns=["frame", "bz", "by", "bx", "pz", "py", "px", "data"])

    def receive(pdf: pd.DataFrame) -> pd.DataFrame:
        own = tuple(int(pdf[c].iloc[0]) for c in ("bz", "by", "bx"))
        shape = [hi - lo + 2 * k for (lo, hi), k in zip((p[i] for p, i in zip(parts, own, strict=True)), wide, strict=True)]
        channels = len(pdf["data"].iloc[0]) // 8 // (len(pdf["pz"].iloc[0]) * len(pdf["py"].iloc[0]) * len(pdf["px"].iloc[0]))
        a = np.full((channels, *shape), outside)
        for r in pdf.itertuples():
            a[:, np.asarray(r.pz)[:, None, None], np.asarray(r.py)[:, None], np.asarray(r.px)] = np.frombuffer(r.data).reshape(channels, len(r.pz), len(r.py), len(r.px))
        out = kernel(a)[:, *(slice(k, n - k) for k, n in zip(wide, shape, strict=True))]
        return pdf[["frame", "bz", "by", "bx"]].head(1).assign(data=[np.ascontiguousarray(out).tobytes()])

    sent = blocks.mapInPandas(send, "frame long, bz int, by int, bx int, pz array<int>, py array<int>, px array<int>, data binary")
    return sent.groupBy("frame", "bz", "by", "bx").applyInPandas(receive, _BLOCKS)


def denoised_blocks(blocks: DataFrame, weight: float, w: int, h: int, d: int, how: str = "volume", steps: int = 5, together: int = 5, block: tuple[int, int, int] = BLOCK) -> DataFrame:
    """Blocks after `steps` dual steps, and as denoised values; `together` of the steps are taken between exchanges."""
    if weight <= 0:
        return blocks
    axes, size = AXES[how], (d, h, w)
    k, rate = len(axes), 1 / (4 * len(axes))

    def kernel(n: int, last: bool):
        def run(a: np.ndarray) -> np.ndarray:
            out = []
            for c in range(2):
                x, g = a[c], [a[2 + c * k + i] for i in range(k)] if len(a) > 2 else [np.zeros_like(a[c]) for _ in range(k)]
                for _ in range(n):
                    u = x - weight * divergence(g, axes)
                    g = [p + rate / weight * q for p, q in zip(g, differences(u, axes), strict=True)]
                    length = np.maximum(1, np.sqrt(sum(p * p for p in g)))
                    g = [p / length for p in g]
                out.append((x, g))
            if last:
                return np.stack([x - weight * divergence(g, axes) for x, g in out])
            return np.stack([x for x, _ in out] + [p for _, g in out for p in g])

        return run

    left = steps
    while True:
        n = min(together, left)
        left -= n
        made = _exchanged(blocks, size, block, n + 1, axes, kernel(n, left == 0))
        if left == 0:
            return made
        blocks = materialize(made, "dual")


def denoise(voxels: DataFrame, weight: float, w: int, h: int, d: int, how: str = "volume", steps: int = 5, together: int = 5, block: tuple[int, int, int] = BLOCK) -> DataFrame:
    """argmin |u - v|^2 / 2 + weight TV(u) of each component of the volumes of frames, by `steps` projected steps on the dual; `how` is volume, planes, z, or alternate (planes, then z)."""
    made = to_blocks(voxels, w, h, d, block)
    for one in ("planes", "z") if how == "alternate" else (how,):
        made = denoised_blocks(made, weight, w, h, d, one, steps, together, block)
    return from_blocks(made, w, h, d, block)


def _reconstructed(a: np.ndarray) -> np.ndarray:
    """Channel 1 dilated over 26 neighbours under channel 0 until nothing changes."""
    top, low = a
    while True:
        best = low
        for axis in range(3):
            p = np.pad(best, [(int(i == axis),) * 2 for i in range(3)], constant_values=-np.inf)
            n = best.shape[axis]
            best = np.maximum.reduce([np.take(p, range(k, k + n), axis) for k in range(3)])
        new = np.minimum(best, top)
        if (new == low).all():
            return np.stack([top, low])
        low = new


def h_maxima(voxels: DataFrame, depth: float, w: int, h: int, d: int, block: tuple[int, int, int] = BLOCK) -> DataFrame:
    """(frame, z, y, x, re, im): the h-maxima transform of the real part, negative values as 0: the volume less `depth`, grown back under the volume.

    Each block is grown until it settles, then borders are exchanged, until no block changes: as many rounds as a
    plateau's way goes through blocks, and one.
    """
    size = (d, h, w)

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for data in batch["data"]:
                top = np.maximum(np.frombuffer(data).reshape(2, -1)[0], 0)
                made.append(np.stack([top, np.maximum(top - depth, 0)]).tobytes())
            yield batch.assign(data=made)

    def end(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            halves = [np.frombuffer(x).reshape(2, -1)[1] for x in batch["data"]]
            yield batch.assign(data=[np.stack([x, np.zeros_like(x)]).tobytes() for x in halves])

    now, before = to_blocks(voxels, w, h, d, block).mapInPandas(start, _BLOCKS), None
    while True:
        now = materialize(_exchanged(now, size, block, 1, (0, 1, 2), _reconstructed, periodic=False, outside=-np.inf), "h-maxima")
        digest = now.agg(F.sum(F.xxhash64("frame", "bz", "by", "bx", "data").cast("decimal(38,0)"))).first()[0]
        if digest == before:
            return from_blocks(now.mapInPandas(end, _BLOCKS), w, h, d, block)
        before = digest


def box_sums(frames: DataFrame, wide: int, high: int) -> DataFrame:
    """(frame, y, x, sum, n): sums over rectangles of `wide` x `high` around each pixel and how many pixels of the image these have; of an even size the additional pixel is on the higher side.

    Two running sums, along x and then along y, of which two places are subtracted: the cost doesn't depend on the size.
    """
    from pyspark.sql.window import Window

    from .frames import pixels

    rows = pixels(frames).withColumn("n", F.lit(1).cast("long"))
    for axis, other, size in (("x", "y", wide), ("y", "x", high)):
        over = Window.partitionBy("frame", other)
        order = over.orderBy(axis)
        low, up = (size - 1) // 2, size // 2
        running = {c: F.sum(c).over(order.rowsBetween(Window.unboundedPreceding, 0)) for c in ("v", "n")}
        totals = {f"{c}_all": F.sum(c).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) for c in ("v", "n")}
        rows = rows.withColumns({f"{c}_upto": e for c, e in running.items()} | totals)
        ahead = lambda c: F.coalesce(F.lead(f"{c}_upto", up).over(order), F.col(f"{c}_all")) if up else F.col(f"{c}_upto")  # noqa: E731, B023
        behind = lambda c: F.coalesce(F.lag(f"{c}_upto", low + 1).over(order), F.lit(0))  # noqa: E731, B023
        rows = rows.select("frame", "y", "x", (ahead("v") - behind("v")).alias("v"), (ahead("n") - behind("n")).alias("n"))
    return rows.withColumnRenamed("v", "sum")


def box_mean(frames: DataFrame, wide: int, high: int) -> DataFrame:
    """(frame, y, x, v): means over rectangles, at borders of the pixels there are."""
    return box_sums(frames, wide, high).select("frame", "y", "x", (F.col("sum") / F.col("n")).alias("v"))
