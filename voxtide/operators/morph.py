"""Morphology of sparse volumes: a voxel is sent to the cells around it, and cells are grouped.

Offsets are small literal tables, so an operation is one explode and one aggregate that is combined before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELL = ("frame", "z", "y", "x")


def ball(radius: float, dims: str = "zyx") -> list[tuple[int, int, int]]:
    """Offsets (z, y, x) within `radius` along `dims`."""
    r = int(radius)
    span = {a: range(-r, r + 1) if a in dims else (0,) for a in "zyx"}
    return [(z, y, x) for z in span["z"] for y in span["y"] for x in span["x"] if z * z + y * y + x * x <= radius * radius]


def cube(size: int) -> list[tuple[int, int, int]]:
    """Offsets of a cube; of an even size the additional cell is on the higher side."""
    lo = -((size - 1) // 2)
    r = range(lo, lo + size)
    return [(z, y, x) for z in r for y in r for x in r]


def disk(radius: int) -> list[tuple[int, int, int]]:
    """Offsets in a plane: the diamond of radius 2, else the cells within the circle."""
    if radius == 2:
        return [(0, y, x) for y in range(-2, 3) for x in range(-2, 3) if abs(x) + abs(y) <= 2]
    return ball(radius, "yx")


def neighbours26(half: bool = False) -> list[tuple[int, int, int]]:
    """Offsets to the 26 neighbours, or to the half of them that comes later in (z, y, x) order."""
    all_ = [(z, y, x) for z in (-1, 0, 1) for y in (-1, 0, 1) for x in (-1, 0, 1) if (z, y, x) != (0, 0, 0)]
    return [o for o in all_ if o > (0, 0, 0)] if half else all_


def stencil(voxels: DataFrame, offsets: list[tuple[int, int, int]], w: int, h: int, d: int) -> DataFrame:
    """(frame, z, y, x, n): how many voxels send to each cell of the volume."""
    moves = F.explode(F.array(*[F.struct(*[F.lit(k).alias(a) for a, k in zip("zyx", o, strict=True)]) for o in offsets])).alias("o")
    sent = voxels.select("frame", "z", "y", "x", moves).select("frame", *[(F.col(a) + F.col(f"o.{a}")).cast("int").alias(a) for a in "zyx"])
    inside = sent.filter(F.col("z").between(0, d - 1) & F.col("y").between(0, h - 1) & F.col("x").between(0, w - 1))
    return inside.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"))


def dilate(voxels: DataFrame, offsets: list[tuple[int, int, int]], w: int, h: int, d: int) -> DataFrame:
    """Cells that some voxel reaches. `voxels` has a cell once."""
    return stencil(voxels, offsets, w, h, d).drop("n")


def erode(voxels: DataFrame, offsets: list[tuple[int, int, int]], w: int, h: int, d: int) -> DataFrame:
    """Cells around which every cell of the (symmetric) element is a voxel; cells outside the volume are none, so faces erode."""
    return stencil(voxels, offsets, w, h, d).filter(F.col("n") == len(offsets)).drop("n")


def close(voxels: DataFrame, radius: float, w: int, h: int, d: int) -> DataFrame:
    """Dilation and then erosion with a ball; a radius of 0 or less changes nothing."""
    if radius <= 0:
        return voxels.select(*CELL)
    element = ball(radius)
    return erode(dilate(voxels, element, w, h, d), element, w, h, d)


def opened(voxels: DataFrame, offsets: list[tuple[int, int, int]], w: int, h: int, d: int) -> DataFrame:
    """Erosion and then dilation."""
    return dilate(erode(voxels, offsets, w, h, d), offsets, w, h, d)


def undo_dilation(labels: DataFrame, voxels: DataFrame) -> DataFrame:
    """Labels of the cells that were voxels before."""
    return labels.join(voxels.select(*CELL), list(CELL), "left_semi")


def tile_corners(frames: DataFrame, size: int) -> DataFrame:
    """(frame, x, y): the corners of each image's tiles, as `tiles` gives them for its size."""
    step = max(1, size - 2 * (size // 8))
    end = lambda n: F.col(n) - size
    along = lambda n: F.when(end(n) <= 0, F.array(F.lit(0))).otherwise(F.concat(F.sequence(F.lit(0), end(n) - 1, F.lit(step)), F.array(end(n))))
    rows = frames.select("frame", "h", F.explode(along("w")).alias("x"))
    return rows.select("frame", "x", F.explode(along("h")).alias("y"))


def tiles(w: int, h: int, size: int) -> list[tuple[int, int]]:
    """Corners (x, y) of tiles of `size` that overlap by a quarter (an eighth on each side); the last is moved inside."""
    step = max(1, size - 2 * (size // 8))

    def along(n: int) -> list[int]:
        if n <= size:
            return [0]
        return [*range(0, n - size, step), n - size]

    return [(x, y) for y in along(h) for x in along(w)]
