"""What is written of each frame: planes as images, non-zeros, iteration tables, focus values.

Everything is a table first and a file then: values are expressions on rows, files are written by Spark's CSV and text
writers in a folder per frame, or, images, by the file writer of `sequence`. No task holds more than a plane.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import arrays as A
from .sequence import image_bytes, read_sequence, write_files

#: Lines of iteration tables: number, objective, share of zeros, step, backtracks so far.
METRICS = ("it", "f", "sparsity", "stepsize", "total_backtracks")


def real_plane_images(planes: DataFrame, prefix: str = "") -> DataFrame:
    """(name, h, w, px) of real planes (frame, z_idx, h, w, re): values of 0..1 become 0..255."""
    name = F.format_string(f"%06d/{prefix}plane_%04d.tif", "frame", "z_idx")
    return planes.select(name.alias("name"), "h", "w", A.rescale(F.col("re"), 255).alias("px"))


def complex_plane_images(planes: DataFrame, prefix: str = "") -> DataFrame:
    """(name, h, w, px) of complex planes: magnitudes, where the range over a frame's planes becomes 0..255 (a flat one 0), and the distance of phases from pi, where 0..pi becomes 0..255."""
    zipped = F.arrays_zip("re", "im")
    mag = F.transform(zipped, lambda v: A.magnitude(v["re"], v["im"]))
    rows = planes.withColumns({"mag": mag, "phase": F.transform(zipped, lambda v: A.phase(v["re"], v["im"]))})
    span = planes.groupBy("frame").agg(F.min(F.array_min(mag)).alias("lo"), F.max(F.array_max(mag)).alias("hi"))
    scaled = F.when(F.col("hi") > F.col("lo"), F.transform("mag", lambda v: (v - F.col("lo")) / (F.col("hi") - F.col("lo")) * 255)).otherwise(F.transform("mag", lambda v: F.lit(0.0)))
    kinds = F.array(
        F.struct(F.format_string(f"%06d/{prefix}plane_%04d.tif", "frame", "z_idx").alias("name"), scaled.alias("px")),
        F.struct(F.format_string(f"%06d/{prefix}phase_plane_%04d.tif", "frame", "z_idx").alias("name"), F.transform("phase", lambda v: F.abs(v - F.pi()) / F.pi() * 255).alias("px")),
    )
    return rows.join(span, "frame").select("h", "w", F.explode(kinds).alias("i")).select("i.name", "h", "w", "i.px")


def write_planes(planes: DataFrame, folder: str, real: bool = False, prefix: str = "") -> None:
    """An image per plane (and, of complex planes, one of its phase) in a folder per frame."""
    write_files(image_bytes((real_plane_images if real else complex_plane_images)(planes, prefix)), folder)


def read_planes(spark: SparkSession, folder: str, kind: str = "plane", prefix: str = "") -> DataFrame:
    """(frame, z_idx, h, w, px) of images written by `write_planes`; `kind` is plane or phase_plane."""
    rows = read_sequence(spark, f"{folder}/*/{prefix}{kind}_*.tif")
    number = F.element_at(F.split("path", "/"), -2).cast("long")
    return rows.select(number.alias("number"), F.col("frame").cast("int").alias("z_idx"), "h", "w", "px").withColumnRenamed("number", "frame")


def nonzeros(planes: DataFrame) -> DataFrame:
    """(frame, x, y, z, value) of the cells of real planes that aren't zero."""
    cells = planes.select("frame", F.col("z_idx").alias("z"), "w", F.posexplode("re").alias("i", "value")).filter("value <> 0")
    return cells.select("frame", (F.col("i") % F.col("w")).alias("x"), F.expr("i div w").cast("int").alias("y"), "z", "value")


def write_nonzeros(planes: DataFrame, folder: str) -> None:
    """Lines of x, y, z, value in a folder per frame, of each task by planes, columns and rows."""
    rows = nonzeros(planes).sortWithinPartitions("frame", "z", "x", "y").select("frame", "x", "y", "z", F.format_string("%f", "value").alias("value"))
    named = rows.toDF("frame", *schemas.VOXEL_HEADER.split(","))
    named.write.partitionBy("frame").options(header=True, ignoreLeadingWhiteSpace=False).mode("overwrite").csv(folder)


def read_nonzeros(spark: SparkSession, folder: str) -> DataFrame:
    """(frame, x, y, z, value), the value as it is (not squared)."""
    return spark.read.schema("x int, y int, z int, value double, frame long").options(header=True, enforceSchema=True).csv(folder).select("frame", "x", "y", "z", "value")


def write_metrics(metrics: DataFrame, folder: str) -> None:
    """Iteration tables of many frames (frame and `METRICS`): a CSV with a header in a folder per frame; frames that are there are replaced, others stay."""
    rows = metrics.select("frame", *METRICS).repartition("frame").sortWithinPartitions("frame", "it")
    rows.write.partitionBy("frame").option("header", True).option("partitionOverwriteMode", "dynamic").mode("overwrite").csv(folder)


def read_metrics(spark: SparkSession, folder: str) -> DataFrame:
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.SOLVER_METRICS.fields)
    return spark.read.schema(f"{kinds}, frame long").option("header", True).csv(folder).select("frame", *METRICS)


def focus_lines(focus: DataFrame) -> DataFrame:
    """(frame, value): a line of the two sums per plane, `z_idx` in order within a frame."""
    lines = F.array_sort(F.collect_list(F.struct("z_idx", F.format_string("   %.7E   %.7E", "raw_real", "raw_imag").alias("line"))))
    return focus.groupBy("frame").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("value"))


def write_focus_text(focus: DataFrame, folder: str) -> None:
    """Focus values as text in a folder per frame, a line per plane."""
    focus_lines(focus).write.partitionBy("frame").mode("overwrite").text(folder)


def read_focus_text(spark: SparkSession, folder: str) -> DataFrame:
    """(frame, z_idx, raw_real, raw_imag)."""
    files = spark.read.text(folder, wholetext=True)
    lines = files.select(F.col("frame").cast("long").alias("frame"), F.posexplode(F.split(F.regexp_replace("value", r"\s+$", ""), r"\n")).alias("z_idx", "line"))
    cells = F.split(F.trim("line"), r"\s+")
    return lines.select("frame", "z_idx", cells[0].cast("double").alias("raw_real"), cells[1].cast("double").alias("raw_imag"))
