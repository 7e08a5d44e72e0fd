"""From images to tracks: background, reconstruction, segmentation, linking."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Segmentation, Settings
from ..functions import arrays as A
from ..operators import frames as fr
from ..operators import morph, objects, ranges, spectral, volume
from ..sources import parameters, sequence
from ..tables import materialize


def segment(voxels: DataFrame, settings: Segmentation, w: int, h: int, d: int) -> DataFrame:
    """Object statistics of a sparse volume: mask by intensity, close, label, and drop what is small."""
    masked = volume.intensity_mask(voxels, settings.min_intensity)
    closed = morph.close(masked, settings.close_size, w, h, d)
    rows = objects.with_intensity(objects.label_voxels(closed.select("frame", "z", "y", "x"), w, h), voxels)
    return objects.filter_objects(objects.object_stats(rows), settings.min_voxels, settings.min_depth)


def enhanced(frames: DataFrame, settings: Settings, w: int) -> DataFrame:
    """Images in 0..1 with their background removed where there is one to estimate, else centred on their mean."""
    unit = frames.withColumn("px", A.rescale(F.col("px"), 1 / 255))
    if settings.background_stop - settings.background_start < 2:
        return unit.withColumn("px", A.normalize_mean0(F.col("px")))
    first, last, step = fr.mean_frames(settings.background_start, settings.background_stop)
    background = fr.as_image(fr.mean_background(fr.selected(unit, first, last, step)), "bg", w)
    return fr.remove_background(unit, background)


@dataclass
class Run:
    voxels: DataFrame
    objects: DataFrame
    tracks: DataFrame


def run(frames: DataFrame, settings: Settings, w: int, h: int) -> Run:
    """The whole chain; voxels and objects are written tables, so a later step never repeats an earlier one."""
    chosen = fr.selected(frames, settings.start, settings.stop, settings.step)
    voxels = materialize(spectral.inverted(enhanced(chosen, settings, w), settings.optics, settings.solver), "voxels")
    found = materialize(segment(voxels, settings.segmentation, w, h, settings.optics.planes), "objects")
    points = found.select("frame", F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"), F.col("n").cast("double").alias("size"))
    return Run(voxels, found, ranges.link_long(points, settings.linking))


def run_file(spark: SparkSession, path: str, base: Settings | None = None, unit: float = 1.0) -> Run:
    """The whole chain as a parameter file says: which images, of what geometry, how they are inverted and segmented.

    Images are the files of its pattern (a number as %05d), found by their numbers; what no parameter says is as in `base`.
    """
    settings = parameters.load_settings(spark, path, base=base, unit=unit)
    frames = sequence.read_sequence(spark, re.sub(r"%0?\d*[du]", "*", settings.image_pattern)).select("frame", "h", "w", "px")
    if settings.stop < settings.start:  # no number of images: all of them
        first, last = frames.agg(F.min("frame"), F.max("frame")).first()
        settings = replace(settings, start=first or 0, stop=last or 0)
    size = fr.selected(frames, settings.start, settings.start).select("h", "w").first()
    if size is None:
        raise ValueError(f"no image {settings.start} in {settings.image_pattern}")
    return run(frames, settings, size["w"], size["h"])
