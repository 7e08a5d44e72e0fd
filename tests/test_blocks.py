"""Volumes in blocks against the same steps on whole arrays, and rectangle means."""

import numpy as np
import pytest
from voxtide.functions.solvers import tv_denoise
from voxtide.operators import blocks, objects

VOXELS = "frame long, z int, y int, x int, re double, im double"


def volume(spark, shape, seed=0, frames=2):
    rng = np.random.default_rng(seed)
    made = {f: rng.normal(size=shape) * (rng.random(shape) < 0.5) + 1j * rng.normal(size=shape) * (rng.random(shape) < 0.3) for f in range(frames)}
    rows = [(f, int(z), int(y), int(x), float(a[z, y, x].real), float(a[z, y, x].imag)) for f, a in made.items() for z, y, x in zip(*np.nonzero(a))]
    return made, spark.createDataFrame(rows, VOXELS)


def dense(df, shape):
    out = {}
    for r in df.collect():
        out.setdefault(r["frame"], np.zeros(shape, complex))[r["z"], r["y"], r["x"]] = r["re"] + 1j * r["im"]
    return out


@pytest.mark.parametrize(("shape", "block", "steps", "together"), [((6, 7, 9), (4, 3, 5), 5, 2), ((3, 4, 5), (8, 8, 8), 4, 4), ((1, 9, 4), (2, 2, 3), 3, 3)])
def test_blocks_give_what_the_whole_array_gives(spark, shape, block, steps, together):
    made, df = volume(spark, shape)
    d, h, w = shape
    for how, axes in blocks.AXES.items():
        got = dense(blocks.denoise(df, 0.3, w, h, d, how, steps, together, block), shape)
        for f, a in made.items():
            assert np.allclose(got[f], tv_denoise(a, 0.3, axes, steps), atol=1e-12), how
    got = dense(blocks.denoise(df, 0.3, w, h, d, "alternate", steps, together, block), shape)
    want = {f: tv_denoise(tv_denoise(a, 0.3, (1, 2), steps), 0.3, (0,), steps) for f, a in made.items()}
    assert all(np.allclose(got[f], want[f], atol=1e-12) for f in made)


def test_without_weight_or_voxels_nothing_changes(spark):
    made, df = volume(spark, (3, 4, 5))
    got = dense(blocks.denoise(df, 0.0, 5, 4, 3, block=(2, 2, 2)), (3, 4, 5))
    assert all((got[f] == a).all() for f, a in made.items())
    assert blocks.denoise(df.limit(0), 0.3, 5, 4, 3).collect() == []


def test_a_task_holds_one_block(spark):
    """What is sent to a block is the block and its border, whatever the volume."""
    for n, b, border in ((100, 8, 3), (9, 4, 6), (5, 8, 2)):
        parts = blocks.extents((n, n, n), (b, b, b))[0]
        got = [0] * len(parts)
        for own in range(len(parts)):
            for t, places, cells in blocks.shares(parts, n, own, border):
                assert len(places) == len(cells) and (cells >= 0).all() and (cells < parts[own][1] - parts[own][0]).all()
                got[t] += len(places)
        assert got == [hi - lo + 2 * border for lo, hi in parts]


@pytest.mark.parametrize(("wide", "high"), [(1, 1), (3, 3), (4, 7), (40, 2)])
def test_rectangle_means(spark, wide, high):
    rng = np.random.default_rng(3)
    a = rng.random((6, 9))
    df = spark.createDataFrame([(0, 6, 9, a.ravel().tolist())], "frame long, h int, w int, px array<double>")
    for r in blocks.box_mean(df, wide, high).collect():
        rows = slice(max(0, r["y"] - (high - 1) // 2), r["y"] + high // 2 + 1)
        cols = slice(max(0, r["x"] - (wide - 1) // 2), r["x"] + wide // 2 + 1)
        assert np.isclose(r["v"], a[rows, cols].mean())


@pytest.mark.parametrize("block", [(2, 3, 4), (9, 9, 9)])
def test_h_maxima_in_blocks(spark, block):
    rng = np.random.default_rng(5)
    shape = (4, 8, 9)
    made = {f: np.round(rng.normal(size=shape) * 6) for f in range(2)}
    made[2] = np.zeros(shape)
    made[2][0, 0, :] = made[2][0, :, 8] = made[2][:, 7, 8] = 5  # a ridge through many blocks, with its peak at one end
    made[2][3, 7, 8] = 9
    df = spark.createDataFrame([(f, int(z), int(y), int(x), float(a[z, y, x]), 1.0) for f, a in made.items() for z, y, x in zip(*np.nonzero(a))], VOXELS)
    got = dense(blocks.h_maxima(df, 3.0, 9, 8, 4, block), shape)
    for f, a in made.items():
        assert (got[f] == objects.h_maxima_array(np.maximum(a, 0), 3.0)).all()
