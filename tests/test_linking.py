import itertools

import numpy as np
import pytest
from voxtide.config import Linking
from voxtide.functions import linking as L
from voxtide.operators import tracking


def test_bonds_are_all_pairs_within():
    rng = np.random.default_rng(0)
    a, b = rng.uniform(-20, 20, (60, 3)), rng.uniform(-20, 20, (70, 3))
    i, j, d2 = L.bonds(a, b, 6.0)
    want = {(p, q) for p in range(60) for q in range(70) if ((a[p] - b[q]) ** 2).sum() < 36}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and len(i) == len(want)
    assert np.allclose(d2, ((a[i] - b[j]) ** 2).sum(1))


@pytest.mark.parametrize("seed", range(20))
def test_least_total(seed):
    rng = np.random.default_rng(seed)
    rows = [[(int(c), float(rng.uniform(0, 9))) for c in rng.permutation(4)[: rng.integers(1, 5)]] for _ in range(4)]
    cost = lambda pick: sum(dict(r)[c] if c >= 0 else 9.0 for r, c in zip(rows, pick, strict=True))
    best = min(cost(p) for p in itertools.product(*[[*dict(r), -1] for r in rows]) if len([c for c in p if c >= 0]) == len({c for c in p if c >= 0}))
    for solve in (L.best_assignment, L.hungarian):
        got = solve(rows, 9.0)
        used = [c for c in got if c >= 0]
        assert len(used) == len(set(used)) and np.isclose(cost(got), best)


def test_crossing_and_memory():
    frame = np.array([0, 0, 1, 1, 2, 2, 4, 4])
    at = np.array([[0, 0, 0], [10, 0, 0], [1, 0, 0], [9, 0, 0], [2, 0, 0], [8, 0, 0], [3, 0, 0], [7, 0, 0]], float)
    ids = L.track(frame, at, 3.0, 1, 2, 3)
    assert ids.tolist() == [1, 2, 1, 2, 1, 2, 1, 2]
    # a particle that is missing for mem frames goes on, for one more it doesn't; frames are those that are present
    for gap, same in ((1, True), (2, False)):
        f = np.array([0, *range(1, gap + 1), gap + 1])
        other = [[100.0 + k, 0, 0] for k in range(gap)]
        ids = L.track(f, np.array([[0, 0, 0], *other, [1, 0, 0]], float), 3.0, 1, 1, 3)
        assert bool(ids[0] == ids[-1]) == same
    assert L.track(np.array([3, 3]), at[:2], 3.0, 1, 1, 3).tolist() == [0, 0]
    assert L.track(np.zeros(0), np.zeros((0, 3)), 3.0, 1, 1, 3).tolist() == []


def test_row_order_makes_no_difference(spark):
    rng = np.random.default_rng(4)
    start = rng.uniform(0, 60, (12, 3))
    rows = [(0, f, *(start[k] + 0.7 * f + rng.normal(0, 0.1, 3)).tolist(), 1.0) for f in range(8) for k in range(12)]
    schema = "run int, frame long, x double, y double, z double, size double"
    s = Linking(maxdisp=4.0, mem=1, good=3)
    a = tracking.link(spark.createDataFrame(rows, schema), s, "run")
    b = tracking.link(spark.createDataFrame(rows[::-1], schema).repartition(5), s, "run")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert a.groupBy("id").count().filter("count >= 3").count() >= 10


def test_origin_and_sizes_are_left_out(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 5.0), (1, 1.0, 0.0, 0.0, 5.0), (1, 2.0, 0.0, 0.0, 99.0)], "frame long, x double, y double, z double, size double")
    assert [r["x"] for r in tracking.usable(df, Linking(min_size=1, max_size=50)).collect()] == [1.0]


def test_renumber(spark):
    rows = [(k, i) for i, k in enumerate([5, 5, 7, 7, 7, 5, 9, 9, 9, 9, 2])]
    df = spark.createDataFrame(rows, "id long, frame long").repartition(3)
    got = [r["number"] for r in tracking.renumber(df, "id", ["frame"]).orderBy("frame").collect()]
    assert got == [1, 1, 2, 2, 2, 3, 4, 4, 4, 4, 5]


def test_subnetworks(spark):
    rows = [(0, 1, 1), (0, 1, 2), (0, 2, 2), (0, 5, 9), (1, 1, 1)]
    got = {tuple(r)[:3]: r["net"] for r in tracking.subnetworks(spark.createDataFrame(rows, "frame long, part long, part_2 long")).collect()}
    assert got == {(0, 1, 1): 1, (0, 1, 2): 1, (0, 2, 2): 1, (0, 5, 9): 5, (1, 1, 1): 1}
