"""Linking holds a frame and the live tracks, not a sequence."""

import numpy as np
from voxtide.config import Linking
from voxtide.functions import linking
from voxtide.operators import tracking


def test_frames_that_go_on_in_the_next_batch(spark):
    rng = np.random.default_rng(4)
    rows = [(s, f, *(rng.random(3) * 12).tolist()) for s in ("a", "b", None) for f in range(6) for _ in range(9)] + [("one", 3, 1.0, 2.0, 3.0), ("one", 3, 1.5, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "run string, frame int, x double, y double, z double")
    settings = Linking(maxdisp=3.0, mem=1, good=2, dim=3)
    want = set()
    for s in ("a", "b", None):
        mine = sorted(r[1:] for r in rows if r[0] == s)
        ids = linking.track(np.array([r[0] for r in mine]), np.array([r[1:] for r in mine]), 3.0, 1, 2, 3)
        want |= {(s, *r[1:], r[0], int(i)) for r, i in zip(mine, ids, strict=True) if i}
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("4", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            made = tracking.link(df, settings, "run")
            assert {tuple(r) for r in made.collect()} == want
            assert "FlatMapGroupsInPandas" not in made._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
