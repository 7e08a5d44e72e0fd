"""Tiles against whole images."""

import numpy as np
import pytest
from voxtide.operators import detect, tiles

SCHEMA = "frame long, h int, w int, px array<double>"


def spots(seed, h=60, w=75):
    """Dark spots on grey, some of them large, on seams and at borders."""
    rng = np.random.default_rng(seed)
    a = np.full((h, w), 200.0) + rng.integers(-3, 4, (h, w))
    for _ in range(9):
        y, x, r = rng.integers(0, h), rng.integers(0, w), rng.integers(2, 9)
        yy, xx = np.mgrid[0:h, 0:w]
        a[(yy - y) ** 2 + (xx - x) ** 2 < r * r] = 10
    a[30:33, 5:70] = 0
    return a


@pytest.mark.parametrize(("size", "blur", "anchor"), [(16, 3, 1), (200, 4, 1), (7, 2, 0)])
def test_detections_on_tiles_are_those_on_whole_images(spark, size, blur, anchor):
    rows = [(k, *(a := spots(k) / (1.7 if k == 2 else 1)).shape, a.ravel().tolist()) for k in range(3)] + [(9, 4, 5, [7.0] * 20)]
    f = spark.createDataFrame(rows, SCHEMA)
    want = sorted((r["frame"], r["part"], round(r["x"], 9), round(r["y"], 9), r["area"]) for r in detect.detections(f, blur, anchor, 2).collect())
    got = sorted((r["frame"], r["part"], round(r["x"], 9), round(r["y"], 9), r["area"]) for r in tiles.detections(f, size, blur, anchor, 2).collect())
    assert got == want and len(got) > 5


def test_each_cell_is_owned_once(spark):
    rng = np.random.default_rng(0)
    a = rng.random((11, 13))
    f = spark.createDataFrame([(0, 11, 13, a.ravel().tolist())], SCHEMA)
    made = tiles.cut(f, 4, 2)
    assert made.count() == 3 * 4 and made.agg({"th": "max", "tw": "max"}).first()[0] <= 8
    got = tiles.owned(made).collect()
    assert len(got) == a.size and all(a[r["y"], r["x"]] == r["v"] for r in got)
    assert tiles.detections(f.limit(0), 4, 2, 0).collect() == []
