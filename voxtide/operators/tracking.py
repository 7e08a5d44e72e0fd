"""Tracks of particles through frames.

Linking is sequential within a sequence and independent between sequences, so each sequence is one group of a grouped
map; its state is the set of live tracks. What can be said about neighbouring frames alone is relational: bonds are a
distance join, and trivial bonds are window counts over it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Linking
from ..functions.linking import Linker
from ..tables import materialize, ship
from .correlated import ranked
from .graph import connected_components
from .joins import distance_join


def usable(centroids: DataFrame, settings: Linking | None = None) -> DataFrame:
    """Without particles at the origin, and with sizes in range."""
    out = centroids.filter("not (x = 0 and y = 0 and z = 0)")
    if settings and settings.min_size is not None:
        out = out.filter(F.col("size") >= settings.min_size)
    if settings and settings.max_size is not None:
        out = out.filter(F.col("size") <= settings.max_size)
    return out


def link(centroids: DataFrame, settings: Linking, *by: str) -> DataFrame:
    """(by, x, y, z, frame, id) of observations on tracks of at least `good` observations; ids run from 1 in each sequence.

    Rows of a frame are taken in the order of their coordinates, so the result doesn't depend on how rows arrive. They
    come sorted; a task holds a frame and the live tracks, whatever the length of a sequence. Tracks are counted and
    numbered afterwards.
    """
    spark = centroids.sparkSession
    ship(spark)
    axes = ["x", "y", "z"][: settings.dim]
    kinds = {f.name: f.dataType.simpleString() for f in centroids.schema.fields}
    cols = [*by, "x", "y", "z", "frame"]
    key = F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0).alias("none"))
    rows = usable(centroids, settings).select(*cols, F.to_json(key).alias("__key"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "__key").sortWithinPartitions("__key", *[F.col(a).asc_nulls_last() for a in ("frame", "x", "y", "z")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        linker, now, held = None, None, []

        def closed() -> pd.DataFrame:
            frame = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
            return frame.assign(id=linker.add(frame[axes].to_numpy(float)))

        for batch in batches:
            start = 0
            changes = (batch["__key"] != batch["__key"].shift()) | (batch["frame"] != batch["frame"].shift())
            for stop in [*np.flatnonzero(changes.to_numpy())[1:].tolist(), len(batch)]:
                if start == stop:
                    continue
                part = batch.iloc[start:stop]
                at = (part["__key"].iloc[0], part["frame"].iloc[0])
                if at != now:
                    if now is not None:
                        yield closed()
                    if now is None or at[0] != now[0]:
                        linker = Linker(settings.maxdisp, settings.mem, settings.dim)
                    now, held = at, []
                held.append(part)
                start = stop
        if now is not None:
            yield closed()

    schema = ", ".join(f"{c} {kinds[c]}" for c in cols) + ", __key string, id long"
    seen = materialize(rows.mapInPandas(run, schema), "link-seen")
    # a sequence with one frame has no tracks
    many = seen.groupBy("__key").agg(F.min("frame").alias("lo"), F.max("frame").alias("hi")).filter("lo < hi").select("__key")
    tracks = seen.groupBy("__key", "id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= settings.good).join(many, "__key", "left_semi")
    numbers = ranked(tracks.select("__key", "id"), "__key", "id").select("__key", "id", (F.col("rank") + 1).cast("long").alias("__n"))
    return seen.join(numbers, ["__key", "id"]).select(*cols, F.col("__n").alias("id"))


def bonds(centroids: DataFrame, maxdisp: float, axes: tuple[str, ...] = ("x", "y", "z"), on: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of `part` in a frame and `part_2` in the next less than `maxdisp` apart, with d2."""
    now = centroids.select(*on, "frame", "part", *axes)
    then = now.withColumn("frame", F.col("frame") - 1)
    return distance_join(now, then, maxdisp, axes, (*on, "frame"))


def trivial_bonds(bonded: DataFrame, on: tuple[str, ...] = ()) -> DataFrame:
    """Bonds that are the only one of both their ends."""
    a, b = Window.partitionBy(*on, "frame", "part"), Window.partitionBy(*on, "frame", "part_2")
    counted = bonded.withColumns({"na": F.count(F.lit(1)).over(a), "nb": F.count(F.lit(1)).over(b)})
    return counted.filter("na = 1 and nb = 1").drop("na", "nb")


def subnetworks(bonded: DataFrame) -> DataFrame:
    """`bonded` (frame, part, part_2) with `net`: the least bond end of the connected subnetwork a bond is in, within its pair of frames."""
    end = lambda c, side: F.struct("frame", F.lit(side).alias("side"), F.col(c).alias("part"))
    parts = connected_components(bonded.select(end("part", 0).alias("src"), end("part_2", 1).alias("dst")))
    of = parts.filter("node.side = 0").select(F.col("node.frame").alias("frame"), F.col("node.part").alias("part"), F.col("component.part").alias("net"))
    return bonded.join(of, ["frame", "part"])


def speeds(tracks: DataFrame, *by: str) -> DataFrame:
    """`tracks` with speed (distance to the point before; null at the first) and smooth (mean of it and its neighbours)."""
    w = Window.partitionBy(*by, "id").orderBy("frame")
    step = sum(((F.col(a) - F.lag(a).over(w)) ** 2 for a in "xyz"), F.lit(0.0))
    return tracks.withColumn("speed", F.sqrt(step)).withColumn("smooth", F.avg("speed").over(w.rowsBetween(-1, 1)))


def extents(tracks: DataFrame, *by: str) -> DataFrame:
    """Per track: points, first and last frame, bounds."""
    return tracks.groupBy(*by, "id").agg(F.count(F.lit(1)).alias("n"), F.min("frame").alias("first"), F.max("frame").alias("last"), *[f(a).alias(f"{a}{k}") for a in "xyz" for k, f in (("min", F.min), ("max", F.max))])


def renumber(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """`rows` with `number`: runs of equal `key` in `order`, from 1.

    Changes are found in ranges of the order and their counts summed up over ranges, so no task holds all rows.
    """
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("part", F.spark_partition_id())
    ranged = materialize(ranged, "renumber")
    own = Window.partitionBy("part").orderBy(*order)
    run = ranged.withColumn("new", F.coalesce((F.col(key) != F.lag(key).over(own)).cast("int"), F.lit(0)))
    run = run.withColumn("upto", F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    edge = ranged.groupBy("part").agg(F.min_by(key, F.struct(*order)).alias("head"), F.max_by(key, F.struct(*order)).alias("tail"))
    edge = edge.join(run.groupBy("part").agg(F.max("upto").alias("inside")), "part")
    over = Window.orderBy("part")  # a row per partition
    start = F.coalesce((F.col("head") != F.lag("tail").over(over)).cast("int"), F.lit(1))
    edge = edge.withColumn("first", F.sum(start).over(over) + F.coalesce(F.sum("inside").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return run.join(F.broadcast(edge.select("part", "first")), "part").withColumn("number", (F.col("first") + F.col("upto")).cast("long")).drop("part", "new", "upto", "first")


def display_filter(tracks: DataFrame, until: float, share: float) -> DataFrame:
    """Points up to frame `until` of the first share of the tracks (by id, one at least). Points without an id count as a track, the last one, and are left out."""
    # ranks are counted in ranges of ids
    ids = ranked(tracks.select("id").distinct().withColumn("all", F.lit(0)), "all", "id")
    first = ids.filter(F.col("rank") < F.greatest(F.lit(1), F.floor(F.col("total") * share))).select("id")
    return tracks.filter(F.col("frame") <= until).join(first, "id", "left_semi")


def as_lines(tracks: DataFrame, *by: str) -> DataFrame:
    """(by, id, points): the points of each track by frame."""
    return tracks.groupBy(*by, "id").agg(F.array_sort(F.collect_list(F.struct("frame", "x", "y", "z"))).alias("points"))
