"""Text and binary files of voxels, centroids, points, tracks, focus values and settings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schemas
from ..functions.arrays import last_number
from ..tables import ship


def _frame() -> object:
    return last_number(F.element_at(F.split(F.input_file_name(), "/"), -1))


def read_voxels(spark: SparkSession, path: str, w: int | None = None, h: int | None = None) -> DataFrame:
    """Files of x, y, z, value: the value is a squared magnitude, of which the root is the real part (the phase isn't kept). With sizes, voxels outside are an error."""
    rows = spark.read.schema(schemas.VOXEL_FILE).option("header", True).option("enforceSchema", False).option("ignoreLeadingWhiteSpace", True).option("mode", "FAILFAST").csv(path)
    out = rows.select(_frame().alias("frame"), "z", "y", "x", F.sqrt("value").alias("re"), F.lit(0.0).alias("im"))
    if w and h:
        ok = F.col("x").between(0, w - 1) & F.col("y").between(0, h - 1) & (F.col("z") >= 0)
        out = out.withColumn("z", F.when(ok, F.col("z")).otherwise(F.raise_error(F.lit("a voxel lies outside the volume")).cast("int")))
    return out


def voxel_file(voxels: DataFrame) -> DataFrame:
    power = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    return voxels.select("x", "y", "z", power.alias("value")).sortWithinPartitions("z", "y", "x")


def write_lines(rows: DataFrame, path: str, header: str | None = None, **options) -> None:
    """CSV parts with a fixed header line."""
    names = header.split(",") if header else rows.columns
    rows.toDF(*[n.strip() if header and ", " in header else n for n in names]).write.options(header=bool(header), **options).csv(path)


def read_centroids(spark: SparkSession, path: str) -> DataFrame:
    """(frame, x, y, z, size): cells that aren't numbers are null, rows without a number go, and the size is the last column."""
    lines = spark.read.text(path).withColumn("frame", _frame())
    cells = F.transform(F.split("value", ","), lambda c: F.trim(c).try_cast("double"))
    rows = lines.select("frame", cells.alias("c")).filter(F.exists("c", lambda c: c.isNotNull()))
    return rows.select("frame", *[F.get("c", F.lit(i)).alias(a) for i, a in enumerate("xyz")], F.element_at("c", -1).alias("size"))


def centroid_file(stats: DataFrame, how: str = "plain") -> DataFrame:
    """Of object statistics: plain, weighted or verbose (15 columns)."""
    c = {"plain": ("cx", "cy", "cz"), "weighted": ("wx", "wy", "wz")}
    if how == "verbose":
        bounds = [f"{a}{e}" for a in "xyz" for e in ("min", "max")]
        return stats.select(F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"), "wx", "wy", "wz", "n", "vmax", "vmean", *bounds)
    return stats.select(*[F.col(k).alias(a) for k, a in zip(c[how], "xyz", strict=True)], "n")


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """Lines of x, y, z, frame, ID apart by commas, semicolons or tabs; lines without five numbers are skipped."""
    cells = F.transform(F.split("value", "[,;\t]"), lambda c: F.trim(c).try_cast("double"))
    rows = spark.read.text(path).select(cells.alias("c")).filter((F.size("c") >= 5) & F.forall(F.slice("c", 1, 5), lambda x: x.isNotNull()))
    return rows.select(*[F.col("c")[i].alias(a) for i, a in enumerate(("x", "y", "z", "frame"))], F.col("c")[4].cast("long").alias("id"))


def track_file(tracks: DataFrame) -> DataFrame:
    return tracks.select("x", "y", "z", "frame", F.col("id").alias("ID"))


def read_points2d(spark: SparkSession, path: str, one_based: bool = True) -> DataFrame:
    """(frame, part, time, x, y, size): blank-separated columns; each time is a frame, numbered in their order."""
    cells = F.transform(F.split(F.trim("value"), r"\s+"), lambda c: c.cast("double"))
    shift = 1.0 if one_based else 0.0
    rows = spark.read.text(path).filter(F.trim("value") != "").select(F.monotonically_increasing_id().alias("line"), cells.alias("c"))
    rows = rows.select("line", F.col("c")[0].alias("time"), (F.col("c")[1] - shift).alias("x"), (F.col("c")[2] - shift).alias("y"), F.get("c", F.lit(3)).alias("size"))
    times = rows.groupBy("time").agg(F.min("line").alias("first"), F.max("line").alias("last"))
    order = Window.orderBy("time")  # a row per frame
    times = times.withColumn("frame", F.row_number().over(order) - 1).withColumn("before", F.lag("last").over(order))
    times = times.withColumn("frame", F.when(F.coalesce(F.col("before") < F.col("first"), F.lit(True)), F.col("frame")).otherwise(F.raise_error(F.lit("times decrease")).cast("int")))
    part = F.row_number().over(Window.partitionBy("time").orderBy("line")) - 1
    return rows.withColumn("part", part).join(F.broadcast(times.select("time", "frame")), "time").select("frame", "part", "time", "x", "y", "size")


def points2d_lines(points: DataFrame, one_based: bool = True) -> DataFrame:
    shift = 1.0 if one_based else 0.0
    return points.select(F.format_string("%16.7E%16.7E%16.7E%16.7E", "time", F.col("x") + shift, F.col("y") + shift, "size").alias("value"))


def points_per_frame(points: DataFrame) -> DataFrame:
    return points.groupBy("frame").agg(F.count(F.lit(1)).alias("n"))


def upsert_points(points: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("frame", "part")) -> DataFrame:
    """`points` with the rows of `new` added or replaced by key; a missing part of a key equals a missing one."""
    old, by = points.alias("old"), new.select(*[F.col(k).alias(f"__{k}") for k in keys])
    same = [F.col(f"old.{k}").eqNullSafe(F.col(f"__{k}")) for k in keys]
    return old.join(by, same, "left_anti").unionByName(new)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(y, cells) of a text matrix with blank-separated numbers, in the order of lines."""
    cells = F.transform(F.split(F.trim("value"), r"[\s,]+"), lambda c: c.cast("double"))
    rows = spark.read.text(path).filter(F.trim("value") != "").select(F.monotonically_increasing_id().alias("line"), cells.alias("cells"))
    return rows.select("line", "cells")


def matrix_lines(rows: DataFrame) -> DataFrame:
    return rows.orderBy("line").select(F.array_join(F.transform("cells", lambda c: F.format_string("   %.7E", c)), "").alias("value"))


def matrix_yaml(name: str, values: np.ndarray) -> str:
    """A matrix in the YAML form of computer-vision tools."""
    data = ", ".join(f"{v:.9g}" for v in values.ravel())
    return f"%YAML:1.0\n---\n{name}: !!opencv-matrix\n   rows: {values.shape[0]}\n   cols: {values.shape[1]}\n   dt: d\n   data: [ {data} ]\n"


def read_matrix_yaml(text: str) -> np.ndarray:
    import re

    rows, cols = (int(re.search(rf"{k}:\s*(\d+)", text)[1]) for k in ("rows", "cols"))
    data = re.search(r"data:\s*\[(.*?)\]", text, re.S)[1]
    return np.array([float(x) for x in data.replace("\n", " ").split(",") if x.strip()]).reshape(rows, cols)


def read_focus(spark: SparkSession, path: str) -> DataFrame:
    """(path, z_idx, raw_real, raw_imag) of files of big-endian double pairs."""
    ship(spark)

    def run(batches):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                v = np.frombuffer(bytes(content), ">f8").reshape(-1, 2).astype(float)
                yield pd.DataFrame({"path": path, "z_idx": np.arange(len(v)), "raw_real": v[:, 0], "raw_imag": v[:, 1]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, z_idx int, raw_real double, raw_imag double")


def focus_bytes(rows: list[tuple[float, float]]) -> bytes:
    return np.array(rows, ">f8").tobytes()


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of key = value files; lines that aren't, and comments, are skipped."""
    rows = spark.read.text(path).filter(~F.trim("value").startswith("#") & F.col("value").contains("="))
    key, value = F.trim(F.substring_index("value", "=", 1)), F.trim(F.regexp_replace("value", "^[^=]*=", ""))
    return rows.select(key.alias("key"), value.alias("value")).filter("key <> ''")


def read_state(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def stats_lines(stats: DataFrame) -> DataFrame:
    """The four lines of a background's statistics."""
    return stats.select(F.explode(F.array(*[F.col(c).cast("string") for c in ("alpha", "beta", "minimum", "average")])).alias("value"))
