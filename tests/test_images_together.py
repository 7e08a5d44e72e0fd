"""Images of a batch are computed together, whatever their sizes, and give what each gives alone."""

import numpy as np
from pyspark.sql import functions as F
from voxtide.config import Optics, Solver
from voxtide.functions import optics as O
from voxtide.functions import solvers
from voxtide.operators import spectral

OPTICS = Optics(z0=10.0, dz=20.0, planes=5, wavelength=0.6, resolution=8.0, zero_pad=0)


def images(spark, n=9):
    rng = np.random.default_rng(3)
    made = [(i, 4 + i // 3, 5, np.round(rng.normal(size=(4 + i // 3) * 5) * 40, 3).tolist()) for i in range(n)]
    return spark.createDataFrame(made, "frame long, h int, w int, px array<double>"), {i: np.array(px).reshape(h, w) for i, h, w, px in made}


def test_spectra_are_summed_before_they_are_shuffled(spark):
    f, single = images(spark)
    planes = spectral.propagated(f, OPTICS)
    back = spectral.back_projected(planes, OPTICS)
    plan = back._jdf.queryExecution().executedPlan().toString().split("Exchange", 1)
    assert len(plan) == 2 and plan[1].count("MapInArrow") == 2  # planes are made, and summed by the tasks that made them
    want = {}
    for i, image in single.items():
        spectra = [np.fft.fft2(image) * O.transfer("rs_phase", *image.shape, z, 0.6, 8.0) for z in OPTICS.depths()]
        want[i] = np.fft.ifft2(sum(s * O.transfer("rs_phase", *image.shape, -z, 0.6, 8.0) for s, z in zip(spectra, OPTICS.depths(), strict=True))).real
    # planes of a frame lie in several tasks, and between those of others
    for p in (planes, planes.repartition(3, "z"), planes.orderBy(F.hash("frame", "z_idx"))):
        got = {r["frame"]: np.array(r["px"]).reshape(r["h"], r["w"]) for r in spectral.back_projected(p, OPTICS).collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[i], want[i]) for i in want)


def test_fista_takes_images_together(spark):
    f, single = images(spark)
    for how, tv in (("l1", 0.0), ("fused2d", 0.3), ("fused3d", 0.3), ("alternate", 0.3)):
        s = Solver(l1=0.5, tv=tv, outer=6)
        one = {i: solvers.fista(spectral._problem(image, OPTICS, s, how), 6)[0] for i, image in single.items()}
        stack = np.stack([single[i] for i in range(3)])
        assert (solvers.fista_together(spectral._problem(stack, OPTICS, s, how), 6) == np.stack([one[i] for i in range(3)])).all()
        got = {(r["frame"], r["z"], r["y"], r["x"]): complex(r["re"], r["im"]) for r in spectral.inverted(f, OPTICS, s, how, "fista").collect()}
        assert got == {(i, *at): complex(x[at]) for i, x in one.items() for at in zip(*(k.tolist() for k in np.nonzero(x)), strict=True)}
