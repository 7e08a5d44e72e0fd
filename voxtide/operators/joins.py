"""Joins by distance and by overlap, as equality joins on grid cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distance_join(a: DataFrame, b: DataFrame, radius: float, axes: tuple[str, ...] = ("x", "y", "z"), on: tuple[str, ...] = ()) -> DataFrame:
    """Rows of `a` and `b` less than `radius` apart that agree in `on`; columns of `b` other than `on` get the suffix _2, and d2 is the squared distance.

    `a` lies in one cell of a grid of twice the radius; `b` is sent to the cells that its surroundings reach (8 in three
    axes, in the mean), so pairs meet once, in an equality join. Both sides are shuffled: the size that is estimated of
    the sent rows is that of the table before they are multiplied, and what looks small to broadcast isn't.
    """
    side = 2.0 * radius
    cell = lambda v: F.floor(v / side).cast("long")
    reach = lambda c: radius * (1 + 1e-9) + F.abs(F.col(c)) * 1e-12  # with room for rounding
    left = a.withColumns({f"__g{i}": cell(F.col(c)) for i, c in enumerate(axes)})
    right = b.select(*on, *[F.col(c).alias(f"{c}_2") for c in b.columns if c not in on])
    for i, c in enumerate(axes):
        right = right.withColumn(f"__g{i}", F.explode(F.sequence(cell(F.col(f"{c}_2") - reach(f"{c}_2")), cell(F.col(f"{c}_2") + reach(f"{c}_2")))))
    keys = [*on, *(f"__g{i}" for i in range(len(axes)))]
    d2 = sum(((F.col(c) - F.col(f"{c}_2")) ** 2 for c in axes), F.lit(0.0))
    return left.join(right.hint("merge"), keys).withColumn("d2", d2).filter(F.col("d2") < radius * radius).drop(*(f"__g{i}" for i in range(len(axes))))


def boxes_overlap(boxes: DataFrame, size: int, grow: int = 0) -> DataFrame:
    """(frame, a, b), a < b: objects of a frame whose boxes (label, xmin .. zmax) meet after growing each by `grow`.

    A box is sent to the cells of a grid of `size` that it touches; a pair is taken in the cell that holds the corner
    of their common box with the least coordinates, so once.
    """
    lo = {a: F.col(f"{a}min") - grow for a in "xyz"}
    hi = {a: F.col(f"{a}max") + grow for a in "xyz"}
    rows = boxes.select("frame", "label", *[lo[a].alias(f"{a}lo") for a in "xyz"], *[hi[a].alias(f"{a}hi") for a in "xyz"])
    for a in "xyz":
        rows = rows.withColumn(f"g{a}", F.explode(F.sequence(F.floor(F.col(f"{a}lo") / size), F.floor(F.col(f"{a}hi") / size))))
    keys = ["frame", "gx", "gy", "gz"]
    other = rows.select(*keys, F.col("label").alias("b"), *[F.col(f"{a}{e}").alias(f"{a}{e}2") for a in "xyz" for e in ("lo", "hi")])
    met = rows.withColumnRenamed("label", "a").join(other, keys).filter("a < b")
    for a in "xyz":
        met = met.filter((F.col(f"{a}lo") <= F.col(f"{a}hi2")) & (F.col(f"{a}lo2") <= F.col(f"{a}hi")))
        met = met.filter(F.col(f"g{a}") == F.floor(F.greatest(F.col(f"{a}lo"), F.col(f"{a}lo2")) / size))
    return met.select("frame", "a", "b")
