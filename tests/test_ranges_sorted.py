"""Ranges are linked from sorted rows, frame by frame, wherever a batch ends."""

import numpy as np
import pandas as pd
from voxtide.config import Linking
from voxtide.operators import ranges


def test_batches_of_any_size():
    rng = np.random.default_rng(8)
    settings = Linking(maxdisp=3.0, mem=1, good=2, dim=3)
    p = pd.DataFrame(rng.random((90, 3)) * 9, columns=["x", "y", "z"]).assign(frame=np.repeat(np.arange(9.0), 10))
    p = p.assign(warm=p["frame"] < 3, seq="s", span=1, age=np.nan).sort_values(["frame", "x", "y", "z"])
    want = ranges.link_range(p, pd.DataFrame({"slot": []}), settings)
    for size in (1, 7, 90):
        got = pd.concat(ranges.link_sorted((p.iloc[k : k + size] for k in range(0, 90, size)), settings), ignore_index=True)
        pd.testing.assert_frame_equal(got[want.columns], want, check_dtype=False)
