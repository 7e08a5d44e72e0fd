"""Labelling voxels, and the objects that labels make."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import linear_index
from ..tables import ship
from .graph import connected_components
from .joins import boxes_overlap, distance_join
from .morph import neighbours26


def label_arrays(z: np.ndarray, y: np.ndarray, x: np.ndarray, w: int, h: int) -> np.ndarray:
    """26-connected components of one volume: for each voxel the least linear index of its component.

    Voxels are sorted by index once; each offset is one binary search for all voxels; labels then fall to the least
    neighbour's and jump to their label's label until nothing changes.
    """
    index = (z.astype(np.int64) * h + y) * w + x
    order = np.argsort(index)
    index, zs, ys, xs = index[order], z[order].astype(np.int64), y[order].astype(np.int64), x[order].astype(np.int64)
    a, b = [], []
    for dz, dy, dx in neighbours26(half=True):
        ok = (ys + dy >= 0) & (ys + dy < h) & (xs + dx >= 0) & (xs + dx < w)
        want = index + (dz * h + dy) * w + dx
        at = np.searchsorted(index, want)
        hit = np.flatnonzero(ok & (at < len(index)) & (index[np.minimum(at, len(index) - 1)] == want))
        a.append(hit)
        b.append(at[hit])
    a, b = np.concatenate(a), np.concatenate(b)
    label = np.arange(len(index))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == label).all():
            break
        label = new
    out = np.empty(len(index), np.int64)
    out[order] = index[label]
    return out


def label_voxels(voxels: DataFrame, w: int, h: int) -> DataFrame:
    """`voxels` with `label`: frames are labelled each in one task, as one frame fits an executor's memory."""
    ship(voxels.sparkSession)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in voxels.schema.fields) + ", label long"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(label=label_arrays(pdf["z"].to_numpy(), pdf["y"].to_numpy(), pdf["x"].to_numpy(), w, h))

    return voxels.groupBy("frame").applyInPandas(one, schema)


def label_voxels_distributed(voxels: DataFrame, w: int, h: int, d: int) -> DataFrame:
    """The same for frames of any size: edges by an equality join on neighbouring cells, then connected components over all tasks."""
    node = F.col("frame") * F.lit(w * h * d).cast("long") + linear_index(F.col("x"), F.col("y"), F.col("z"), F.lit(w), F.lit(h)).cast("long")
    nodes = voxels.withColumn("node", node)
    moves = F.explode(F.array(*[F.struct(*[F.lit(k).alias(a) for a, k in zip("zyx", o, strict=True)]) for o in neighbours26(half=True)])).alias("o")
    sent = nodes.select("frame", "z", "y", "x", F.col("node").alias("src"), moves).select("src", "frame", *[(F.col(a) + F.col(f"o.{a}")).cast("int").alias(a) for a in "zyx"])
    edges = sent.join(nodes.select("frame", "z", "y", "x", F.col("node").alias("dst")), ["frame", "z", "y", "x"]).select("src", "dst")
    parts = connected_components(edges)
    label = F.coalesce("component", "node") - F.col("frame") * F.lit(w * h * d).cast("long")
    return nodes.join(parts, "node", "left").withColumn("label", label).drop("node", "component")


def with_intensity(labels: DataFrame, voxels: DataFrame) -> DataFrame:
    """(frame, label, z, y, x, value): the power of each labelled voxel, 0 where the volume has none."""
    keys = ["frame", "z", "y", "x"]
    power = (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("value")
    return labels.select(*keys, "label").join(voxels.select(*keys, power), keys, "left").na.fill(0.0, ["value"])


def object_stats(rows: DataFrame) -> DataFrame:
    """Per object of (frame, label, z, y, x, value): voxels, centroid, weighted centroid, greatest and mean value, bounds."""
    weighted = lambda a: F.when(F.sum("value") > 0, F.sum(F.col("value") * F.col(a)) / F.sum("value")).otherwise(F.avg(a))
    return rows.groupBy("frame", "label").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(a).alias(f"c{a}") for a in "xyz"],
        *[weighted(a).alias(f"w{a}") for a in "xyz"],
        F.max("value").alias("vmax"),
        F.avg("value").alias("vmean"),
        *[f(a).alias(f"{a}{n}") for a in "xyz" for n, f in (("min", F.min), ("max", F.max))],
    )


def filter_objects(stats: DataFrame, least: int = 1, least_depth: int = 0) -> DataFrame:
    """Objects of at least `least` voxels and a z extent of at least `least_depth`."""
    return stats.filter((F.col("n") >= least) & (F.col("zmax") - F.col("zmin") >= least_depth))


def merge_objects(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Objects that pairs (frame, a, b) link, through others too, become one with the least label, each voxel once."""
    end = lambda c: F.struct("frame", F.col(c).alias("label"))
    parts = connected_components(pairs.select(end("a").alias("src"), end("b").alias("dst")))
    new = parts.select("node.frame", "node.label", F.col("component.label").alias("to"))
    moved = rows.join(new, ["frame", "label"], "left").withColumn("label", F.coalesce("to", "label")).drop("to")
    return moved.dropDuplicates(["frame", "label", "z", "y", "x"])


def sharing_pairs(rows: DataFrame) -> DataFrame:
    """(frame, a, b): objects with a voxel in common; each is linked to the least object at the voxel."""
    least = rows.groupBy("frame", "z", "y", "x").agg(F.min("label").alias("a"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    return rows.join(least, ["frame", "z", "y", "x"]).filter("label <> a").select("frame", "a", F.col("label").alias("b")).distinct()


def near_pairs(rows: DataFrame, distance: float) -> DataFrame:
    """(frame, a, b): objects with voxels less than `distance` apart."""
    slim = rows.select("frame", "label", *[F.col(a).cast("double").alias(a) for a in "xyz"])
    return distance_join(slim, slim, distance, on=("frame",)).filter("label < label_2").select("frame", F.col("label").alias("a"), F.col("label_2").alias("b")).distinct()


def prune_overlaps(rows: DataFrame, distance: float = 0.0) -> DataFrame:
    """Objects that share voxels, or come within `distance`, merged."""
    return merge_objects(rows, near_pairs(rows, distance) if distance > 0 else sharing_pairs(rows))


def box_pairs(stats: DataFrame, cell: int = 32, grow: int = 0) -> DataFrame:
    return boxes_overlap(stats, cell, grow)


def focus_mask(rows: DataFrame) -> DataFrame:
    """(frame, label, y, x): the voxels of an object in the plane, moved by one both ways."""
    return rows.select("frame", "label", (F.col("y") + 1).alias("y"), (F.col("x") + 1).alias("x")).distinct()


def depth_by_intensity(points: DataFrame, voxels: DataFrame) -> DataFrame:
    """`points` (frame, part, x, y) with z, the plane of the greatest power at the rounded place; of equal ones the highest."""
    power = (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("v")
    px = points.withColumns({"xi": F.floor(F.col("x") + 0.5).cast("int"), "yi": F.floor(F.col("y") + 0.5).cast("int")})
    profile = px.join(voxels.select("frame", F.col("x").alias("xi"), F.col("y").alias("yi"), "z", power), ["frame", "xi", "yi"], "left")
    return profile.groupBy("frame", "part", "x", "y").agg(F.max(F.struct("v", "z"))["z"].alias("z"))


def union_clouds(*clouds: DataFrame) -> DataFrame:
    out = clouds[0]
    for c in clouds[1:]:
        out = out.unionByName(c)
    return out


def fill_field(rows: DataFrame, w: int, h: int, value: float = 1.0) -> DataFrame:
    """Voxels of objects as a volume: `value` where some object is."""
    inside = rows.filter(F.col("x").between(0, w - 1) & F.col("y").between(0, h - 1))
    return inside.select("frame", "z", "y", "x").distinct().withColumns({"re": F.lit(value), "im": F.lit(0.0)})


def moved(rows: DataFrame, dx: int = 0, dy: int = 0, dz: int = 0) -> DataFrame:
    """Coordinates in another frame of reference, as from a region to its image."""
    return rows.withColumns({a: F.col(a) + k for a, k in (("x", dx), ("y", dy), ("z", dz))})


def touching(rows: DataFrame, w: int, h: int, d: int) -> DataFrame:
    """(frame, label) of objects at a face of the volume."""
    face = F.col("x").isin(0, w - 1) | F.col("y").isin(0, h - 1) | F.col("z").isin(0, d - 1)
    return rows.filter(face).select("frame", "label").distinct()


def h_maxima_array(volume: np.ndarray, h: float) -> np.ndarray:
    """Reconstruction of volume - h under volume by dilation over 26 neighbours; negative values become 0."""
    low = np.maximum(volume - h, 0)
    while True:
        p = np.pad(low, 1, constant_values=-np.inf)
        best = low
        for dz, dy, dx in np.ndindex(3, 3, 3):
            best = np.maximum(best, p[dz : dz + low.shape[0], dy : dy + low.shape[1], dx : dx + low.shape[2]])
        new = np.minimum(best, volume)
        if (new == low).all():
            return low
        low = new


def h_maxima(voxels: DataFrame, depth: float, w: int, h: int, d: int) -> DataFrame:
    """Voxels of the h-maxima transform of the real part; a frame is one group."""
    ship(voxels.sparkSession)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((d, h, w))
        a[pdf["z"], pdf["y"], pdf["x"]] = np.maximum(pdf["re"], 0)
        out = h_maxima_array(a, depth)
        z, y, x = np.nonzero(out)
        return pd.DataFrame({"frame": pdf["frame"].iloc[0], "z": z, "y": y, "x": x, "re": out[z, y, x], "im": 0.0})

    return voxels.groupBy("frame").applyInPandas(one, "frame long, z int, y int, x int, re double, im double")
