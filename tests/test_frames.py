import numpy as np
import pytest
from helpers import same_dense
from pyspark.sql import functions as F
from voxtide.functions import arrays as A
from voxtide.operators import correlated, detect
from voxtide.operators import frames as fr

SCHEMA = "seq int, frame long, h int, w int, px array<double>"


def sequence(spark, values, seq=0, w=2, h=2):
    return spark.createDataFrame([(seq, i, h, w, [float(v)] * (w * h)) for i, v in enumerate(values)], SCHEMA)


def image(spark, a):
    a = np.asarray(a, float)
    return spark.createDataFrame([(0, 0, *a.shape, a.ravel().tolist())], SCHEMA)


def px(df):
    return np.array(df.first()["px"])


def test_normalisations(spark):
    a = np.array([[1.0, 2], [3, 6]])
    f = image(spark, a)
    col = F.col("px")
    assert same_dense(px(f.select(A.normalize(col).alias("px"))), a.ravel() / 3)
    assert same_dense(px(f.select(A.normalize_inverse(col).alias("px"))), 1 - a.ravel() / 3)
    assert same_dense(px(f.select(A.normalize_mean0(col).alias("px"))), a.ravel() / 3 - 1)
    assert np.isclose(px(f.select(A.normalize_mean0(col).alias("px"))).mean(), 0)
    for how, go in (("normalize", A.normalize), ("inverse", A.normalize_inverse), ("mean0", A.normalize_mean0)):
        assert same_dense(px(f.select(A.denormalize(go(col), F.lit(3.0), how).alias("px"))), a.ravel())
    m = px(f.select(A.match_mean_std(col, F.lit(10.0), F.lit(2.0)).alias("px")))
    assert np.isclose(m.mean(), 10) and np.isclose(m.std(), 2)
    assert px(image(spark, [[4, 4]]).select(A.match_mean_std(col, F.lit(10.0), F.lit(2.0)).alias("px"))).tolist() == [10, 10]


def test_rounding_and_crop(spark):
    r = spark.createDataFrame([(0.5,), (1.5,), (-0.5,), (2.4,), (300.0,), (-3.0,)], "v double").select(A.rounded(F.col("v")).alias("a"), A.eight_bit(F.col("v")).alias("b")).collect()
    assert [x["a"] for x in r] == [1, 2, -1, 2, 300, -3] and [x["b"] for x in r] == [0, 2, 0, 2, 255, 0]
    f = image(spark, np.arange(12).reshape(3, 4))
    got = px(f.select(A.crop(F.col("px"), F.col("w"), 2, -1, 3, 3).alias("px"))).reshape(3, 3)
    assert got.tolist() == [[0, 0, 0], [2, 3, 0], [6, 7, 0]]
    pad = px(f.select(A.zero_pad(F.col("px"), F.col("w"), F.col("h"), 1).alias("px"))).reshape(5, 6)
    assert (pad == np.pad(np.arange(12).reshape(3, 4), 1)).all()
    at = spark.range(0, 70).select(A.from_linear(F.col("id"), 4, 5, 3).alias("p"), "id").collect()
    assert all((r["p"]["z"] * 5 + r["p"]["y"]) * 4 + r["p"]["x"] == (r["id"] if r["id"] < 60 else 0) for r in at)


def test_median_with_warm_up(spark):
    v = [9, 1, 5, 3, 7, 2, 8, 4, 6, 0, 11, 10]
    got = {r["frame"]: r["bg"] for r in fr.median5_background(sequence(spark, v), "seq").filter("x = 0 and y = 0").collect()}
    slots, want = v[:5], {}
    for i in range(len(v) - 2):
        if i >= 3:
            slots[(i - 3) % 5] = v[i]
        want[i] = sorted(slots)[2]
    assert got == want
    assert all(want[i] == sorted(v[i - 4 : i + 1])[2] for i in range(7, 10))
    assert fr.median5_background(sequence(spark, v[:4]), "seq").count() == 0


@pytest.mark.parametrize("width", [3, 4, 6, 11])
def test_moving_window(spark, width):
    v = [float(x * x) for x in range(12)]
    got = {r["frame"]: r["bg"] for r in fr.moving_background(sequence(spark, v), width, "seq").filter("x = 1 and y = 1").collect()}
    for n in range(12):
        s = max(0, min(n - width // 2, 11 - width + 1))
        assert np.isclose(got[n], np.mean(v[s : s + width - 2]))


def test_mean_background_and_stats(spark):
    assert fr.mean_frames(0, 11) == (0, 9, 1) and fr.mean_frames(0, 1001) == (0, 999, 5)
    rng = np.random.default_rng(0)
    stack = rng.random((6, 4))
    f = spark.createDataFrame([(0, i, 2, 2, p.tolist()) for i, p in enumerate(stack)], SCHEMA)
    bg = fr.as_image(fr.mean_background(f), "bg", 2)
    assert same_dense(px(bg), stack.mean(0))
    s = fr.background_stats(f, bg).first()
    rest = stack - stack.mean(0)
    assert np.isclose(s["alpha"], rest.mean(1).mean() - 5 * rest.std(1).mean()) and np.isclose(s["beta"], 255 / (10 * rest.std(1).mean()))
    out = np.array([r["px"] for r in fr.remove_background(f, bg).orderBy("frame").collect()])
    assert same_dense(out, rest / np.maximum(np.sqrt(stack.mean(0)), 0.1))


def test_correlation_background(spark):
    rng = np.random.default_rng(1)
    stack = rng.integers(0, 255, (7, 9)).astype(float)
    f = spark.createDataFrame([(0, i, 3, 3, p.tolist()) for i, p in enumerate(stack)], SCHEMA)
    corr = {(r["frame"], r["other"]): r["corr"] for r in fr.correlations(f, "seq").collect()}
    assert all(np.isclose(c, np.corrcoef(stack[a], stack[b])[0, 1], atol=1e-6) for (a, b), c in corr.items()) and len(corr) == 42
    for r in correlated.correlation_background(f, "seq", 2, 4, 1.0).collect():
        order = sorted((b for b in range(7) if b != r["frame"]), key=lambda b: (-corr[r["frame"], b], b))
        rest = [stack[r["frame"]] - stack[order[:m]].mean(0) for m in range(1, 5)]
        bins = [np.bincount(np.clip(np.floor(np.maximum(x, 0) + 0.5), 0, 255).astype(int)) / 9 for x in rest]
        e = np.array([-(p[p > 0] * np.log(p[p > 0])).sum() for p in bins])
        e3 = np.array([e[max(0, i - 1) : i + 2].mean() for i in range(4)])
        fall = [i for i in range(1, 4) if e3[i] < e3[i - 1] - 1e-9]
        assert r["used"] == max(1, min(fall[0] if fall else 1, 3)) + 1 and same_dense(r["px"], stack[order[: r["used"]]].mean(0))
    small = px(correlated.resized(f.filter("frame = 0"), "seq", 0.67))
    assert len(small) == 4 and np.isclose(small.mean(), stack[0].mean())
    assert fr.first_descent(np.array([1.0, 2, 2, 1])) == 3 and fr.first_descent(np.array([1.0, 2])) is None
    assert np.allclose(fr.smoothed(np.array([0.0, 3, 6])), [1.5, 3, 4.5])
    assert fr.entropy(np.zeros(9)) == 0


def test_detection():
    a = np.full((40, 40), 200.0)
    a[10:14, 10:14] = 0
    a[25:30, 30:34] = 0
    found = detect.detect2d(a, blur=2, anchor=0, opening=2)
    assert len(found) == 2 and abs(found[0][0] - 11.5) < 1.5 and abs(found[1][1] - 27) < 1.5
    assert detect.detect2d(np.full((20, 20), 7.0)) == []
    mask = np.array([[1, 0, 0], [0, 1, 0], [0, 0, 0], [0, 0, 1]], bool)
    assert detect.label2d(mask).max() == 2


def test_regions_windows_entropy(spark):
    a = np.arange(30.0).reshape(5, 6)
    f = image(spark, a)
    points = spark.createDataFrame([(0, 0, 0.0, 0.0), (0, 1, 3.2, 2.4)], "frame long, part long, x double, y double")
    got = {r["part"]: np.array(r["px"]).reshape(2, 2) for r in fr.regions(f, points, 2).collect()}
    assert got[0].tolist() == [[0, 0], [0, 0.0]] and got[1].tolist() == [[8, 9], [14, 15]]
    from voxtide.functions import optics as O

    w = px(fr.windowed(f, 0.6)).reshape(5, 6)
    assert same_dense(w, a * np.outer(O.tukey(5, 0.6), O.tukey(6, 0.6)), 1e-9)
    assert np.isclose(fr.image_entropy(f).first()["entropy"], fr.entropy(a.ravel()))
