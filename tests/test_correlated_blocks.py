"""Bounded correlation whose bounds rule nothing out: work and memory are those of tiles."""

import numpy as np
from voxtide.operators import correlated
from voxtide.operators import frames as fr


def test_noise_needs_all_pairs_and_no_row_of_them(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i % 2, i, 4, 4, p.tolist()) for i, p in enumerate(rng.integers(0, 255, (700, 16)).astype(float))]
    f = spark.createDataFrame(rows, "seq int, frame long, h int, w int, px array<double>")
    written, keep = {}, correlated.materialize
    monkeypatch.setattr(correlated, "materialize", lambda df, tag: written.setdefault(tag, keep(df, tag)))
    found = correlated.best_correlated_bounded(f, "seq", 3, digits=6, block_bytes=4 * 4 * 8 * 120)
    want = fr.best_correlated(f, "seq", 3, digits=6)
    assert sorted(map(tuple, found.best.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    # a row per image and pair of blocks at most, and best ones of it, where there are candidates nearly everywhere
    assert all(t.count() <= 700 * 3 * 3 + 30 for t in written.values()), {k: t.count() for k, t in written.items()}
    assert not [c for t in written.values() for c, kind in t.dtypes if kind == "array<bigint>"]
