"""State of linking streams is read and written once a batch, and bonds leave out what has no place."""

import numpy as np
import pytest
from voxtide.config import Linking
from voxtide.functions import linking
from voxtide.plans import catalog
from voxtide.streaming import live


def test_state_is_not_sent_with_each_chunk_of_rows(spark):
    rng = np.random.default_rng(6)
    rows = [(s, f, *(rng.random(3) * 20).tolist()) for s in ("a", None) for f in range(8) for _ in range(30)]
    df = spark.createDataFrame(rows, "run string, frame long, x double, y double, z double")
    made = live.link_stream(catalog._stream(spark, df), "run", Linking(maxdisp=3.0, mem=1, good=1, dim=3))
    assert "TransformWithState" in made._jdf.queryExecution().logical().toString()
    want = set()
    for s in ("a", None):
        mine = sorted(r[1:] for r in rows if r[0] == s)
        ids = linking.track(np.array([r[0] for r in mine]), np.array([r[1:] for r in mine]), 3.0, 1, 1, 3)
        want |= {(s, *r[1:], r[0], int(i)) for r, i in zip(mine, ids, strict=True) if r[0] < 7}
    assert {tuple(r) for r in live.run_once(spark, made).collect()} == want


@pytest.mark.parametrize("dim", [1, 2, 3])
def test_bonds_against_all_pairs(monkeypatch, dim):
    monkeypatch.setattr(linking, "TOGETHER", 7)
    rng = np.random.default_rng(dim)
    a, b = np.round(rng.normal(size=(60, dim)) * 6), np.round(rng.normal(size=(50, dim)) * 6)
    a[3, 0] = b[4, dim - 1] = np.nan
    d2 = ((a[:, None] - b[None]) ** 2).sum(2)
    i, j = np.nonzero(d2 < 9)
    got = linking.bonds(a, b, 3.0)
    assert all((x == y).all() for x, y in zip(got, (i, j, d2[i, j]), strict=True)) and len(i) > 20
