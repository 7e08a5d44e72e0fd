"""Large images as tiles: a row per tile with a border, what is found in it belongs to the tile that owns the cell.

An image is cut by array expressions where its row is. Stencils run on a tile with a border as wide as they reach, and
their cells outside the owned square are dropped, so cells of all tiles are those of the whole image, each once.
Objects may lie across any number of tiles: the cells that make them up are labelled together, over all tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..tables import materialize, ship
from .detect import box_blur, dilate2d, erode2d
from .objects import label_voxels_distributed

TILE = "frame long, ty int, tx int, y0 int, x0 int, oy int, ox int, oh int, ow int, th int, tw int, px array<double>"


def cut(frames: DataFrame, size: int, border: int) -> DataFrame:
    """Rows of `TILE`: squares of `size` owned cells from (oy, ox), oh x ow of them inside the image, and the cells (y0, x0, th, tw, px) they have with a border that ends at the image's edges."""
    rows = frames.select(F.col("frame").cast("long").alias("frame"), F.col("h").alias("fh"), F.col("w").alias("fw"), "px")
    along = lambda n: F.sequence(F.lit(0), (F.ceil(F.col(n) / size) - 1).cast("int"))
    rows = rows.select("*", F.explode(along("fh")).alias("ty")).select("*", F.explode(along("fw")).alias("tx"))
    rows = rows.withColumns({"oy": F.col("ty") * size, "ox": F.col("tx") * size})
    rows = rows.withColumns({
        "oh": F.least(F.lit(size), F.col("fh") - F.col("oy")), "ow": F.least(F.lit(size), F.col("fw") - F.col("ox")),
        "y0": F.greatest(F.col("oy") - border, F.lit(0)), "x0": F.greatest(F.col("ox") - border, F.lit(0)),
        "th": F.least(F.col("oy") + size + border, F.col("fh")), "tw": F.least(F.col("ox") + size + border, F.col("fw")),
    })
    rows = rows.withColumns({"th": F.col("th") - F.col("y0"), "tw": F.col("tw") - F.col("x0")})
    line = lambda i: F.slice("px", (F.col("y0") + i) * F.col("fw") + F.col("x0") + 1, F.col("tw"))
    px = F.flatten(F.transform(F.sequence(F.lit(0), F.col("th") - 1), line))
    return rows.select("frame", "ty", "tx", "y0", "x0", "oy", "ox", "oh", "ow", "th", "tw", px.alias("px"))


def mapped(tiles: DataFrame, one: Callable[[np.ndarray, float | None], np.ndarray], extra: str | None = None) -> DataFrame:
    """Tiles with `one` of their cells, as an array of the same shape; it also gets the column `extra` of the tile, if there is one."""
    ship(tiles.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = batch[extra] if extra else [None] * len(batch)
            made = [one(np.asarray(p, float).reshape(h, w), v) for p, h, w, v in zip(batch["px"], batch["th"], batch["tw"], values, strict=True)]
            yield batch.drop(columns=[extra] if extra else []).assign(px=[np.asarray(m, float).ravel() for m in made])

    return tiles.mapInPandas(run, TILE)


def owned(tiles: DataFrame) -> DataFrame:
    """(frame, y, x, v) of the cells that tiles own."""
    cells = tiles.select("frame", "y0", "x0", "oy", "ox", "oh", "ow", "tw", F.posexplode("px").alias("i", "v"))
    cells = cells.withColumns({"y": (F.col("y0") + F.expr("i div tw")).cast("int"), "x": (F.col("x0") + F.col("i") % F.col("tw")).cast("int")})
    inside = (F.col("y") >= F.col("oy")) & (F.col("y") < F.col("oy") + F.col("oh")) & (F.col("x") >= F.col("ox")) & (F.col("x") < F.col("ox") + F.col("ow"))
    return cells.filter(inside).select("frame", "y", "x", "v")


def detections(frames: DataFrame, size: int, blur: int = 10, anchor: int = 4, opening: int = 2) -> DataFrame:
    """(frame, part, x, y, area): what `detect.detections` finds, with images cut into tiles. Half of an image's most frequent grey is found over its tiles."""
    grey = lambda a, _: np.clip(np.rint(box_blur(a, blur, anchor)), 0, 255)
    blurred = materialize(mapped(cut(frames, size, blur + 2 * opening + 1), grey), "tiles")
    counts = owned(blurred).groupBy("frame", "v").agg(F.count(F.lit(1)).alias("n"))
    half = counts.groupBy("frame").agg((F.max_by("v", F.struct("n", -F.col("v"))) / 2).alias("cut"))
    opened = lambda a, t: dilate2d(erode2d(a < t, opening), opening)
    dark = owned(mapped(blurred.join(half, "frame"), opened, "cut")).filter("v > 0").select("frame", F.lit(0).alias("z"), "y", "x")
    dark = materialize(dark, "tiles-dark")
    w, h = frames.agg(F.coalesce(F.max("w"), F.lit(1)), F.coalesce(F.max("h"), F.lit(1))).first()
    found = label_voxels_distributed(dark, w, h, 1).groupBy("frame", "label").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count(F.lit(1)).cast("int").alias("area"))
    part = F.row_number().over(Window.partitionBy("frame").orderBy("label")) - 1
    return found.select("frame", part.cast("long").alias("part"), "x", "y", "area")
