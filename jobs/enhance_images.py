"""Backgrounds of image sequences, and their images with the background taken away.

    python jobs/enhance_images.py --images PATH --output PATH [--config PATH] [--parameters PATH]

Reads a Parquet table of images (an array of values a row), makes each sequence's mean image and the range its images
spread over, and writes, partitioned by sequence,

    OUTPUT/backgrounds   h, w, bg, n, alpha, beta, minimum, average
    OUTPUT/images        frame, h, w, px: in 0..255, ready for reconstruction

The config says which columns hold what (`enhance_images.conf` is the default). A parameter file may choose images by
number (START_IMAGE, NUM_IMAGES) and those of the background (BG_START, BG_END). Sequences that are in the input
replace what the output had of them, others stay; a run that is repeated writes the same rows.

Rows without a sequence are a sequence; rows without a frame or pixels, or whose pixels aren't whole lines, are left out
and counted in the log. Sequences whose images differ in size are an error.
"""

from __future__ import annotations

import argparse
import logging
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from voxtide.functions import arrays as A
from voxtide.operators import frames as fr
from voxtide.sources import files, parameters
from voxtide.tables import materialize

log = logging.getLogger("voxtide.jobs.enhance_images")
DEFAULTS = {"sequence": "label", "frame": "vec_id", "pixels": "embedding", "width": "8", "gain": "100", "offset": "128", "spread": "5", "low": "0"}
BACKGROUND = "h int, w int, bg array<double>, n long, alpha double, beta double, minimum double, average double"
IMAGE = "frame long, h int, w int, px array<double>"


def config_of(spark: SparkSession, path: str | None) -> dict[str, str]:
    """The defaults with what a file of key = value lines says."""
    said = {r["key"]: r["value"] for r in files.read_pairs(spark, path).collect()} if path else {}
    if unknown := said.keys() - DEFAULTS.keys():
        raise ValueError(f"no such setting: {', '.join(sorted(unknown))}")
    return DEFAULTS | said


def images_of(table: DataFrame, config: dict[str, str]) -> DataFrame:
    """(sequence, frame, h, w, px): grey values of 0..255, half to even."""
    w, gain, offset = int(config["width"]), float(config["gain"]), float(config["offset"])
    px = F.transform(config["pixels"], lambda v: A.eight_bit(offset + gain * v.cast("double")))
    rows = table.select(F.col(config["sequence"]).cast("string").alias("sequence"), F.col(config["frame"]).cast("long").alias("frame"), F.col(config["pixels"]).alias("raw"), px.alias("px"))
    whole = (F.size("px") > 0) & (F.size("px") % w == 0) & ~F.exists("raw", lambda v: v.isNull())
    return rows.filter(F.col("frame").isNotNull() & whole).select("sequence", "frame", (F.size("px") / w).cast("int").alias("h"), F.lit(w).alias("w"), "px")


def written(rows: DataFrame, path: str) -> int:
    rows.write.partitionBy("sequence").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    return rows.sparkSession.read.parquet(path).count()


def run(spark: SparkSession, images: str, output: str, config: str | None = None, chosen: str | None = None) -> dict[str, int]:
    """Rows read, used, and in the output after the run; `config` and `chosen` are paths."""
    settings = config_of(spark, config)
    table = spark.read.parquet(images)
    frames = images_of(table, settings)
    behind = frames
    if chosen:
        numbers = parameters.load_settings(spark, chosen)
        if numbers.stop >= numbers.start and numbers.stop > 0:
            frames = fr.selected(frames, numbers.start, numbers.stop)
        if numbers.background_stop > 0:
            behind = fr.selected(behind, numbers.background_start, numbers.background_stop)
    counts = {"read": table.count(), "used": frames.count()}
    log.info("%s: %d rows read, %d images used", images, counts["read"], counts["used"])
    sizes = frames.unionByName(behind).groupBy("sequence").agg(F.count_distinct("h").alias("n")).filter("n > 1").limit(5).collect()
    if sizes:
        raise ValueError(f"images of a sequence differ in size: {', '.join(str(r['sequence']) for r in sizes)}")
    means = materialize(fr.sequence_backgrounds(behind, "sequence"), "enhance-means")
    stats = fr.sequence_stats(behind, means, "sequence", float(settings["spread"]))
    known = materialize(means.join(stats, means["sequence"].eqNullSafe(stats["sequence"])).drop(stats["sequence"]), "enhance-backgrounds")
    counts["backgrounds"] = written(known, f"{output}/backgrounds")
    counts["images"] = written(fr.enhance_sequences(frames, known, "sequence", float(settings["low"])), f"{output}/images")
    log.info("%s: %d backgrounds and %d images are there", output, counts["backgrounds"], counts["images"])
    return counts


def read_output(spark: SparkSession, output: str) -> tuple[DataFrame, DataFrame]:
    """Backgrounds and images."""
    return spark.read.schema(f"{BACKGROUND}, sequence string").parquet(f"{output}/backgrounds"), spark.read.schema(f"{IMAGE}, sequence string").parquet(f"{output}/images")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    p.add_argument("--images", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--config")
    p.add_argument("--parameters")
    a = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("enhance_images").getOrCreate()
    try:
        run(spark, a.images, a.output, a.config, a.parameters)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
