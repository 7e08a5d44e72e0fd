"""What makes many small images cheap: planes transformed together, steps without copies by roll, rows sent together."""

import numpy as np
from voxtide.config import Optics
from voxtide.functions import optics as O
from voxtide.functions import solvers
from voxtide.operators import spectral


def test_planes_together_are_planes_one_by_one(monkeypatch):
    rng = np.random.default_rng(0)
    planes, depths = rng.normal(size=(7, 6, 5)) + 1j * rng.normal(size=(7, 6, 5)), [50.0 * k for k in range(7)]
    total = sum(np.fft.fft2(p) * O.transfer("rs_phase", 6, 5, -z, 0.6, 2.0) for p, z in zip(planes, depths, strict=True))
    back = np.stack([np.fft.ifft2(np.fft.fft2(planes[0].real) * np.conj(O.transfer("rs_phase", 6, 5, -z, 0.6, 2.0))) for z in depths])
    for together in (1, 70, 2**18):
        monkeypatch.setattr(O, "TOGETHER", together)
        assert np.allclose(O.forward(planes, depths, 0.6, 2.0), np.fft.ifft2(total).real)
        assert np.allclose(O.adjoint(planes[0].real, depths, 0.6, 2.0), back)


def test_steps_are_those_of_roll_and_of_both_parts():
    x = np.random.default_rng(1).normal(size=(3, 4, 5))
    for axis in range(3):
        for by in (1, -1):
            assert (solvers._rolled(x, by, axis) == np.roll(x, by, axis)).all()
    c = x + 1j * x[::-1]
    assert (solvers.soft(c, 0.3) == solvers.soft(c.real, 0.3) + 1j * solvers.soft(c.imag, 0.3)).all()
    assert np.allclose(solvers.tv_denoise(c, 0.4, (1, 2)), solvers.tv_denoise(c.real, 0.4, (1, 2)) + 1j * solvers.tv_denoise(c.imag, 0.4, (1, 2)))


def test_a_frame_goes_on_in_the_next_batch(spark):
    rng = np.random.default_rng(2)
    f = spark.createDataFrame([(i, 4, 4, rng.random(16).tolist()) for i in range(5)], "frame long, h int, w int, px array<double>")
    o = Optics(z0=10.0, dz=20.0, planes=3, wavelength=0.6, resolution=8.0, zero_pad=0)
    planes = spectral.propagated(f, o)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    whole = {r["frame"]: r["px"] for r in spectral.back_projected(planes, o).collect()}
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
        assert {r["frame"]: r["px"] for r in spectral.back_projected(planes, o).collect()} == whole and len(whole) == 5
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert "FlatMapGroupsInPandas" not in spectral.back_projected(planes, o)._jdf.queryExecution().toString()
