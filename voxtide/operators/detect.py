"""Detecting particles in images and ranging what detection works on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import objects, volume
from .spectral import _map


def label2d(mask: np.ndarray) -> np.ndarray:
    """8-connected components from 1, 0 outside."""
    y, x = np.nonzero(mask)
    out = np.zeros(mask.shape, int)
    if len(y):
        out[y, x] = np.unique(objects.label_arrays(np.zeros(len(y), int), y, x, mask.shape[1], mask.shape[0]), return_inverse=True)[1] + 1
    return out


def box_blur(image: np.ndarray, size: int, anchor: int) -> np.ndarray:
    """Means of size x size cells around, `anchor` before each; borders are mirrored without the edge cell."""
    p = np.pad(image, ((anchor, size - 1 - anchor),) * 2, mode="reflect") if min(image.shape) > size else np.pad(image, ((anchor, size - 1 - anchor),) * 2, mode="edge")
    # sums in one order at every place, so a part of an image gives the same numbers as the whole
    h, w = image.shape
    rows = sum((p[k : k + h] for k in range(1, size)), p[:h])
    return sum((rows[:, k : k + w] for k in range(1, size)), rows[:, :w]) / size**2


def erode2d(mask: np.ndarray, size: int) -> np.ndarray:
    out = mask.copy()
    for _ in range(size // 2):
        p = np.pad(out, 1, constant_values=True)
        out = np.logical_and.reduce([p[dy : dy + out.shape[0], dx : dx + out.shape[1]] for dy in range(3) for dx in range(3)])
    return out


def dilate2d(mask: np.ndarray, size: int) -> np.ndarray:
    return ~erode2d(~mask, size)


def detect2d(image: np.ndarray, blur: int = 10, anchor: int = 4, opening: int = 2) -> list[tuple[float, float, int]]:
    """(x, y, area) of dark spots: blur, take half of the most frequent grey as threshold, open, label."""
    grey = np.clip(np.rint(box_blur(image, blur, anchor)), 0, 255).astype(int)
    cut = np.bincount(grey.ravel(), minlength=256).argmax() / 2
    mask = grey < cut
    mask = dilate2d(erode2d(mask, opening), opening)
    labels = label2d(mask)
    out = []
    for k in range(1, labels.max() + 1):
        y, x = np.nonzero(labels == k)
        out.append((float(x.mean()), float(y.mean()), len(x)))
    return out


def detections(frames: DataFrame, blur: int = 10, anchor: int = 4, opening: int = 2) -> DataFrame:
    """(frame, part, x, y, area)."""

    def one(frame, image):
        for i, (x, y, area) in enumerate(detect2d(image, blur, anchor, opening)):
            yield frame, i, x, y, area

    return _map(frames, one, "frame long, part long, x double, y double, area int")


def mean_filter2(image: np.ndarray) -> np.ndarray:
    """Means of a cell and its neighbours to the right and below; 0 in the last row and column."""
    out = np.zeros_like(image, dtype=float)
    out[:-1, :-1] = (image[:-1, :-1] + image[1:, :-1] + image[:-1, 1:] + image[1:, 1:]) / 4
    return out


def enhanced(frames: DataFrame, cut: float, border: float = 256.0) -> DataFrame:
    """Images whose last row and column are `border` and whose values of `cut` and more are 256, after a 2 x 2 mean filter."""

    def one(frame, image):
        out = mean_filter2(image)
        out[-1, :] = out[:, -1] = border
        out[out >= cut] = 256.0
        yield frame, *out.shape, out.ravel().tolist()

    return _map(frames, one, "frame long, h int, w int, px array<double>")


def ghosts_removed(points: DataFrame, least: float = 60.0) -> DataFrame:
    return points.filter(F.col("intensity") > least)


def centroids_by_focus(voxels: DataFrame, w: int, h: int) -> DataFrame:
    """(frame, part, x, y, z): bright regions of the projection (above its Otsu threshold, 8-connected), and for each the plane of the greatest power at its centre."""
    top = volume.projection(voxels, "xy", skip_first=False)
    cut = volume.otsu(volume.histogram(top, "v", 256, "frame"), "frame")
    bright = top.join(cut, "frame").filter("v > threshold").select("frame", F.lit(0).alias("z"), "y", "x")
    parts = objects.label_voxels(bright, w, h).groupBy("frame", F.col("label").alias("part")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    return objects.depth_by_intensity(parts, voxels)
