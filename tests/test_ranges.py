"""Long sequences linked in time ranges, against linking them frame by frame."""

import numpy as np
import pandas as pd
import pytest
from voxtide.config import Linking
from voxtide.functions import linking
from voxtide.operators import ranges, tracking

SCHEMA = "run int, frame long, x double, y double, z double, size double"


def crowd(frames, n, seed=0, step=1.0, lost=0.1, grid=None):
    """Particles that drift, cross and go missing; on a grid, ties are common."""
    rng = np.random.default_rng(seed)
    at = rng.random((n, 3)) * 12 + 1
    out = []
    for f in range(frames):
        at = at + rng.normal(size=at.shape) * step
        seen = at[rng.random(n) > lost]
        seen = np.round(seen / grid) * grid if grid else seen
        out += [(f * 3, *map(float, p), 1.0) for p in np.unique(seen, axis=0)]
    return [r for r in out if r[1:4] != (0.0, 0.0, 0.0)]


def whole(rows, settings):
    """All frames as one range."""
    pdf = pd.DataFrame(rows, columns=["frame", "x", "y", "z", "size"]).assign(warm=False)
    got = ranges.link_range(pdf, pd.DataFrame({"slot": []}), settings)
    got = got[got["kind"] == "seen"]
    n = got["local"].value_counts()
    keep = {int(k): i + 1 for i, k in enumerate(sorted(n[n >= settings.good].index))}
    return sorted((r.frame, r.x, r.y, r.z, keep[int(r.local)]) for r in got.itertuples() if int(r.local) in keep)


def linked(spark, rows, settings, **options):
    df = spark.createDataFrame([(0, *r) for r in rows], SCHEMA).repartition(3)
    return sorted((float(r["frame"]), r["x"], r["y"], r["z"], r["id"]) for r in ranges.link_long(df, settings, **options).collect())


@pytest.mark.parametrize(("warm", "mem", "grid"), [(5, 2, None), (-2, 2, None), (0, 1, 2.0)])
def test_equal_to_one_range(spark, warm, mem, grid):
    rows = crowd(40, 12, seed=warm + 9, grid=grid)
    settings = Linking(maxdisp=3.0, mem=mem, good=3, dim=3)
    # a warm-up of no frames guesses every live set wrongly
    assert linked(spark, rows, settings, range_points=60, warm=warm) == whole(rows, settings)


def test_equal_to_linking_frame_by_frame(spark):
    rows = crowd(30, 25, seed=4, step=0.4)
    settings = Linking(maxdisp=1.5, mem=1, good=4, dim=3)
    df = spark.createDataFrame([(0, *r) for r in rows], SCHEMA)
    parts = lambda got: sorted(tuple(sorted((r["frame"], r["x"], r["y"], r["z"]) for r in g)) for g in got.values())
    groups = []
    for d in (ranges.link_long(df, settings, range_points=100), tracking.link(df, settings, "run")):
        got = {}
        for r in d.collect():
            got.setdefault(r["id"], []).append(r)
        groups.append(parts(got))
    assert groups[0] == groups[1] and len(groups[0]) > 10


def test_sequences_nulls_and_two_dimensions(spark):
    rows = [(k, *r) for k in (1, 2, None) for r in crowd(12, 6, seed=k or 7)] + [(9, 0, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    settings = Linking(maxdisp=3.0, mem=1, good=2, dim=2)
    got = ranges.link_long(df, settings, "run", range_points=20)
    assert got.columns == ["run", "x", "y", "z", "frame", "id"]
    found = got.collect()
    assert {r["run"] for r in found} == {1, 2, None}
    for k in (1, 2, None):
        mine = sorted((float(r["frame"]), r["x"], r["y"], r["z"], r["id"]) for r in found if r["run"] == k)
        assert mine == whole([r[1:] for r in rows if r[0] == k], settings)
    assert ranges.link_long(spark.createDataFrame([], SCHEMA), settings).collect() == []


def test_crossing_and_missing(spark):
    rows = [(f, float(f), 5.0, 1.0, 1.0) for f in range(20) if f not in (7, 8)] + [(f, 20.0 - f, 5.4, 1.0, 1.0) for f in range(20)]
    settings = Linking(maxdisp=3.5, mem=2, good=5, dim=3)
    got = linked(spark, rows, settings, range_points=5, warm=-1)
    assert got == whole(rows, settings) and len({r[4] for r in got}) == 2
    assert linking.Linker(1.0, 0, 3).at is None
