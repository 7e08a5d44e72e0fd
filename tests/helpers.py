"""Comparison rules for dense and sparse arrays."""

from __future__ import annotations

import numpy as np


def same_dense(got, want, threshold: float = 1e-5, most: int = 0) -> bool:
    """Fails only if the greatest difference over the mean magnitude exceeds the threshold and more than `most` elements do."""
    got, want = np.asarray(got), np.asarray(want)
    assert got.shape == want.shape and np.isfinite(got).all()
    diff = np.abs(got - want)
    scale = max(float(np.abs(want).mean()), 1e-30)
    over = (diff / scale > threshold) & (diff > np.finfo(np.float32).eps)
    return int(over.sum()) <= most


def same_sparse(got, want, threshold: float = 1e-3) -> bool:
    """Non-zero counts within a thousandth, and relative differences where `want` isn't zero."""
    got, want = np.asarray(got), np.asarray(want)
    a, b = np.count_nonzero(got), np.count_nonzero(want)
    at = want != 0
    return abs(a - b) <= 1e-3 * max(1, b) and bool((np.abs(got[at] - want[at]) <= threshold * np.abs(want[at])).all())
