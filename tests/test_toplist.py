"""Best correlated images of blocks, in tiles."""

import numpy as np
import pytest
from voxtide.functions import toplist
from voxtide.operators import frames as fr


def brute(f, d, g, e, most):
    corr = np.round(np.einsum("ik,jk->ij", d, e) / (np.sqrt(np.outer((d * d).sum(1), (e * e).sum(1))) + 1e-8), 6)
    out = set()
    for i in range(len(f)):
        other = np.flatnonzero(g != f[i])
        out |= {(f[i], g[k], corr[i, k]) for k in other[np.lexsort((g[other], -corr[i, other]))[:most]]}
    return out


def images(n, seed):
    """Random images, with a group of equal ones, flat ones, and ones of few values that tie."""
    rng = np.random.default_rng(seed)
    d = rng.integers(0, 255, (n, 16)).astype(float)
    d[n // 10 : n // 3], d[n // 2 : n // 2 + 9] = d[0], 7
    d[-n // 4 :] = rng.integers(0, 2, (len(d[-n // 4 :]), 16))
    return rng.permutation(3 * n)[:n], d - d.mean(1)[:, None]


@pytest.mark.parametrize("n", [2, 4, 300, 2600])
def test_tiles_give_what_all_pairs_give(n):
    f, d = images(n, 1)
    g, e = images(n // 2 + 1, 2)
    g = g + 3 * n
    (got, pairs), (both, across) = toplist.best_of_blocks((f, d), None, 5, 6), toplist.best_of_blocks((f, d), (g, e), 5, 6)
    assert pairs == n * (n - 1) // 2 and across == n * (n // 2 + 1)
    assert set(zip(*[x.tolist() for x in got], strict=True)) == brute(f, d, f, d, 5)
    assert set(zip(*[x.tolist() for x in both], strict=True)) == brute(f, d, g, e, 5) | brute(g, e, f, d, 5)


def test_a_task_gets_a_pair_of_blocks_once(spark):
    rows = spark.range(40).selectExpr("cast(id % 2 as int) as seq", "id as frame", "id % 3 as block", "3L as blocks")
    met = fr.pairs_of_blocks(rows).groupBy("seq", "i", "j").count().collect()
    assert len(met) == 2 * 6 and sum(r["count"] for r in met) == 40 * 3 and all(r["i"] <= r["j"] for r in met)
