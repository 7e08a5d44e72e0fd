"""Best correlated images through bounds from coarse images."""

import numpy as np
import pytest
from voxtide.operators import correlated
from voxtide.operators import frames as fr

SCHEMA = "seq int, frame long, h int, w int, px array<double>"


def drifting(n, h=16, w=16, seed=0):
    """A scene that changes slowly, as a sequence of images does, with a little noise."""
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:h, 0:w]
    out = []
    for i in range(n):
        t = i / 12
        scene = np.sin(x / 3 + t) + np.cos(y / 4 - t / 2) + np.sin((x + y) / 6 + t * 1.7)
        out.append((scene * 40 + 128 + rng.normal(size=(h, w)) * 0.5).ravel().tolist())
    return out


def test_bounds_hold():
    rng = np.random.default_rng(1)
    for h, w in ((8, 8), (7, 5), (1, 9)):
        a = rng.random((12, h, w)) * 255
        a[3] = a[2]
        a[4] = 7
        dev, size, part, rests = correlated.coarse_parts(a, 4)
        got = dev @ dev.T / (np.outer(size, size) + 1e-8)
        share = np.outer(size, size) / (np.outer(size, size) + 1e-8)
        room = rests @ rests.T
        assert (got <= (part @ part.T + room) * share + 1e-9).all()


@pytest.mark.parametrize("block_bytes", [1, 16 * 16 * 8 * 7, 2**25])
def test_equal_to_all_pairs(spark, block_bytes):
    rows = [(s, 3 * i + (s or 0), 16, 16, p) for s, n in ((0, 25), (1, 40), (2, 1), (None, 3)) for i, p in enumerate(drifting(n, seed=s or 9))] if block_bytes > 1 else [(0, i, 16, 16, p) for i, p in enumerate(drifting(9))]
    rows += [(5, i, 1, 2, [float(i % 2), 0.0]) for i in range(6)] if block_bytes > 1 else []  # flat and equal images: ties
    f = spark.createDataFrame(rows, SCHEMA)
    want = fr.best_correlated(f.filter("seq is not null"), "seq", 4, digits=9)
    got = correlated.best_correlated_bounded(f, "seq", 4, block_bytes=block_bytes, digits=9).best
    same = lambda df: sorted((r["seq"], r["frame"], r["rank"], r["other"], round(r["corr"], 8)) for r in df.collect())
    assert same(got.filter("seq is not null")) == same(want)
    if block_bytes > 1:
        assert got.filter("seq is null").count() == 6 and got.filter("seq = 2").count() == 0


def test_most_pairs_of_a_long_sequence_are_not_computed(spark):
    f = spark.createDataFrame([(0, i, 16, 16, p) for i, p in enumerate(drifting(600))], SCHEMA)
    found = correlated.best_correlated_bounded(f, "seq", 5, block_bytes=16 * 16 * 8 * 100, digits=9)
    r = found.report.first()
    assert r["pairs"] == 600 * 599 // 2 and r["computed"] < r["pairs"] / 10, r
    same = lambda df: sorted((r["frame"], r["rank"], r["other"]) for r in df.collect())
    assert same(found.best) == same(fr.best_correlated(f, "seq", 5, digits=9))


def test_no_images(spark):
    found = correlated.best_correlated_bounded(spark.createDataFrame([], SCHEMA), "seq", 3)
    assert found.best.collect() == [] and found.report.collect() == []
    one = correlated.best_correlated_bounded(spark.createDataFrame([(1, 1, 2, 2, [1.0, 2.0, 3.0, 4.0])], SCHEMA), "seq", 3)
    assert one.best.collect() == [] and one.report.first()["pairs"] == 0


def test_ranks(spark):
    df = spark.createDataFrame([(i % 3 or None, i * 7 % 101) for i in range(100)], "seq int, frame int")
    got = correlated.ranked(df, "seq", "frame").toPandas()
    for _, g in got.groupby("seq", dropna=False):
        assert (g.sort_values("frame")["rank"].to_numpy() == np.arange(len(g))).all() and (g["total"] == len(g)).all()
