import numpy as np
import pytest
from voxtide.operators import graph, joins, morph, objects, volume

SCHEMA = "frame long, z int, y int, x int, re double, im double"


def sparse(spark, cells, frame=0):
    return spark.createDataFrame([(frame, z, y, x, float(v), 0.0) for (z, y, x), v in cells.items()], SCHEMA)


@pytest.fixture(scope="module")
def cells():
    rng = np.random.default_rng(0)
    return {tuple(int(k) for k in p): float(rng.integers(1, 9)) for p in np.argwhere(rng.random((4, 6, 5)) < 0.3)}


def dense(cells, shape=(4, 6, 5)):
    out = np.zeros(shape)
    for k, v in cells.items():
        out[k] = v
    return out


@pytest.mark.parametrize("axes", ["xy", "xyz", "x"])
def test_total_variation(spark, cells, axes):
    a = dense(cells)
    d = [a - np.roll(a, 1, "zyx".index(k)) for k in axes]
    want = np.sqrt(sum(x * x for x in d)).sum()
    assert np.isclose(volume.total_variation(sparse(spark, cells), 5, 6, 4, axes).first()["tv"], want)


def test_projections(spark, cells):
    a = dense(cells)
    got = {(r["y"], r["x"]): r["v"] for r in volume.projection(sparse(spark, cells), "xy").collect()}
    want = a[1:].max(0)  # the first plane is left out
    assert all(got.get((y, x), 0) == want[y, x] for y in range(6) for x in range(5))
    best = {(r["y"], r["x"]): r["z"] for r in volume.arg_plane(sparse(spark, cells)).collect()}
    assert all(z == 3 - a[::-1, y, x].argmax() for (y, x), z in best.items())


def test_planes_round_trip(spark, cells):
    v = sparse(spark, cells)
    back = volume.from_planes(volume.to_planes(v, 5, 6))
    assert {(r["z"], r["y"], r["x"]): r["re"] for r in back.collect()} == cells


def test_histogram_and_otsu(spark):
    values = [0.0] * 50 + [1.0] * 5 + [9.0] * 5 + [10.0] * 40
    df = spark.createDataFrame([(0, v) for v in values], "frame long, v double")
    h = volume.histogram(df, "v", 10, "frame")
    assert sum(r["n"] for r in h.collect()) == 100 and max(r["bin"] for r in h.collect()) == 9
    assert 1 <= volume.otsu(h, "frame").first()["level"] < 9
    assert volume.mode_half(h, "frame").first()["threshold"] == 0
    flat = spark.createDataFrame([(0, 3.0)] * 4, "frame long, v double")
    assert volume.entropy(volume.histogram(flat, "v", 256, "frame"), "frame").first()["entropy"] == 0


def test_morphology(spark):
    one = sparse(spark, {(2, 3, 3): 1})
    assert morph.dilate(one, morph.ball(1), 7, 7, 5).count() == 7
    assert morph.dilate(one, morph.cube(3), 7, 7, 5).count() == 27 and len(morph.cube(2)) == 8
    corner = sparse(spark, {(0, 0, 0): 1})
    assert morph.dilate(corner, morph.ball(1), 7, 7, 5).count() == 4 and morph.erode(corner, morph.ball(1), 7, 7, 5).count() == 0
    shell = {(2 + z, 3 + y, 3 + x): 1 for z, y, x in morph.ball(1) if (z, y, x) != (0, 0, 0)}
    gap = sparse(spark, shell)
    closed = {(r["z"], r["y"], r["x"]) for r in morph.close(gap, 1, 7, 7, 5).collect()}
    assert closed == {*shell, (2, 3, 3)}
    assert morph.close(gap, 0, 7, 7, 5).count() == 6
    again = spark.createDataFrame([(0, *k) for k in closed], "frame long, z int, y int, x int")
    assert {(r["z"], r["y"], r["x"]) for r in morph.close(again, 1, 7, 7, 5).collect()} == closed
    assert len(morph.disk(2)) == 13 and morph.tiles(32, 32, 16)[-1] == (16, 16)
    sizes = [(0, 32, 32), (1, 7, 40), (2, 16, 17), (3, 50, 16)]
    got = morph.tile_corners(spark.createDataFrame(sizes, "frame long, h int, w int"), 16).collect()
    assert sorted(map(tuple, got)) == sorted((f, x, y) for f, h, w in sizes for x, y in morph.tiles(w, h, 16))


def test_labels(spark):
    cells = {(1, 1, 1): 1, (2, 2, 2): 1, (2, 2, 4): 1, (0, 4, 6): 1, (0, 5, 0): 1, (3, 0, 0): 1, (3, 0, 1): 1}
    v = sparse(spark, cells).select("frame", "z", "y", "x")
    both = [objects.label_voxels(v, 7, 7), objects.label_voxels_distributed(v, 7, 7, 4)]
    for out in both:
        label = {(r["z"], r["y"], r["x"]): r["label"] for r in out.collect()}
        assert label[1, 1, 1] == label[2, 2, 2] == 1 * 49 + 7 + 1  # at a corner
        assert label[2, 2, 4] != label[2, 2, 2]
        assert label[0, 4, 6] != label[0, 5, 0]  # the end and the start of neighbouring rows stay apart
        assert label[3, 0, 0] == label[3, 0, 1]


def test_objects(spark):
    rows = spark.createDataFrame([(0, 1, 0, 0, x, float(v)) for x, v in ((0, 1), (1, 3))] + [(0, 2, 1, 1, 1, 0.0)], "frame long, label long, z int, y int, x int, value double")
    s = {r["label"]: r for r in objects.object_stats(rows).collect()}
    assert s[1]["n"] == 2 and s[1]["cx"] == 0.5 and s[1]["wx"] == 0.75 and s[1]["vmax"] == 3 and s[2]["wx"] == 1
    assert objects.near_pairs(rows, 1.8).count() == 1 and objects.near_pairs(rows, 1.2).count() == 0
    assert objects.prune_overlaps(rows, 1.8).select("label").distinct().count() == 1
    shared = rows.unionByName(spark.createDataFrame([(0, 7, 0, 0, 1, 1.0)], rows.schema))
    assert objects.prune_overlaps(shared).filter("label = 1").count() == 2
    assert objects.sharing_pairs(shared).collect()[0][1:] == (1, 7)


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    edges = [tuple(int(x) for x in rng.integers(0, 300, 2)) for _ in range(200)] + [(k, k + 1) for k in range(500, 560)] + [(7, None), (900, 900)]
    parent = {}
    find = lambda a: a if parent.setdefault(a, a) == a else find(parent[a])
    for a, b in edges:
        if b is not None:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {k: find(k) for k in parent}
    assert graph.connected_components(spark.createDataFrame([], "src long, dst long")).collect() == []


def test_distance_join(spark):
    rng = np.random.default_rng(1)
    a, b = rng.uniform(-9, 9, (40, 2)), rng.uniform(-9, 9, (50, 2))
    left = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(a)], "i int, x double, y double")
    right = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(b)], "i int, x double, y double")
    got = {(r["i"], r["i_2"]) for r in joins.distance_join(left, right, 2.0, ("x", "y")).collect()}
    assert got == {(i, j) for i in range(40) for j in range(50) if ((a[i] - b[j]) ** 2).sum() < 4}


def test_joined_volumes(spark, cells):
    v = sparse(spark, cells)
    other = {k: -x for k, x in list(cells.items())[:5]} | {(3, 5, 4): 2.0}
    w = sparse(spark, other)
    a, b = dense(cells), dense(other)
    r = volume.inner_products(v, w).first()
    assert np.isclose(r["dot"], (a * b).sum()) and np.isclose(r["diff2"], ((a - b) ** 2).sum())
    assert np.isclose(volume.line_search_limit(v, w, v, 0.5).first()["bound"], ((a - b) * a).sum() + ((a - b) ** 2).sum())
    assert {(x["z"], x["y"], x["x"]): x["re"] for x in volume.combined(v, w, 1.0, 1.0).collect()} == {tuple(map(int, k)): (a + b)[tuple(k)] for k in np.argwhere(a + b)}


def test_h_maxima():
    a = np.zeros((1, 1, 9))
    a[0, 0] = [0, 5, 3, 4, 0, 9, 0, 1, 0]
    out = objects.h_maxima_array(a, 2.0)[0, 0]
    assert out.tolist() == [0, 3, 3, 3, 0, 7, 0, 0, 0]


def test_focus_and_frames(spark):
    from voxtide.operators import detect

    cells = {(z, y, x): (9.0 if z == 2 else 1.0) for z in range(4) for y in (1, 2) for x in (1, 2)}
    cells |= {(z, 5, 5): (8.0 if z == 1 else 1.0) for z in range(4)} | {(0, y, x): 0.5 for y in range(7) for x in range(7) if (0, y, x) not in cells}
    got = sorted((r["x"], r["y"], r["z"]) for r in detect.centroids_by_focus(sparse(spark, cells), 7, 7).collect())
    assert [g[:2] for g in got] == [(1.5, 1.5), (5.0, 5.0)] and got[1][2] == 1
    image = volume.as_frames(volume.projection(sparse(spark, cells), "xy", skip_first=False), "v", 7, 7).first()
    assert len(image["px"]) == 49 and image["px"][1 * 7 + 1] == 9.0 and image["px"][5 * 7 + 5] == 8.0


def test_merging_and_masks(spark, cells):
    v = sparse(spark, cells)
    other = sparse(spark, {k: x + (1 if k[2] % 2 else 0) for k, x in cells.items()})
    assert all(r["id"] == 1 for r in volume.argmax_merge(v, other).collect())  # ties go to the later
    assert volume.elementwise(v, v, "subtract").count() == 0
    assert not volume.broken_cells(v).first()["broken"]
    nan = spark.createDataFrame([(0, 0, 0, 0, float("nan"), 0.0)], SCHEMA)
    assert volume.broken_cells(nan).first()["broken"]
    polar = volume.from_polar(volume.complex_parts(v).drop("re", "im"))
    assert all(abs(r["re"] - cells[r["z"], r["y"], r["x"]]) < 1e-9 for r in polar.collect())
    denser = volume.denser_planes(sparse(spark, {(0, 0, 0): 2.0, (1, 0, 0): 4.0}), 2).collect()
    assert {r["z"]: r["re"] for r in denser} == {0: 2.0, 1: 3.0, 2: 4.0, 3: 2.0}
    assert objects.touching(objects.label_voxels(sparse(spark, {(1, 1, 1): 1}).select("frame", "z", "y", "x"), 3, 3), 3, 3, 3).count() == 0
