import numpy as np
import pytest
from voxtide.config import Linking, Optics, Segmentation, Settings, Solver
from voxtide.functions import optics as O
from voxtide.operators import tracking
from voxtide.plans import catalog, pipeline
from voxtide.sources import sequence
from voxtide.streaming import live


def stream(spark, df):
    return catalog._stream(spark, df)


def test_rolling_background(spark):
    v = [9, 1, 5, 3, 7, 2, 8, 4, 6, 0]
    df = spark.createDataFrame([("s", i, [float(x)] * 2) for i, x in enumerate(v)], "seq string, frame long, px array<double>")
    got = {r["frame"]: r["px"][0] for r in live.run_once(spark, live.rolling_background(stream(spark, df), "seq")).collect()}
    assert got == {i: float(sorted(v[i - 4 : i + 1])[2]) for i in range(4, 10)}


def test_stream_links_as_batch_does(spark):
    rng = np.random.default_rng(2)
    start = rng.uniform(0, 60, (8, 3))
    rows = [(0, f, *(start[k] + 0.5 * f).tolist(), 1.0) for f in range(8) for k in range(8)]
    df = spark.createDataFrame(rows, "run int, frame long, x double, y double, z double, size double")
    s = Linking(maxdisp=4.0, mem=1, good=1)
    batch = {(r["frame"], r["x"]): r["id"] for r in tracking.link(df, s, "run").collect()}
    got = {(r["frame"], r["x"]): r["id"] for r in live.run_once(spark, live.link_stream(stream(spark, df), "run", s)).collect()}
    # the last frame is open, as more of it may come
    assert len(got) == 7 * 8 and all(batch[k] == v for k, v in got.items())


def test_windows(spark):
    df = spark.createDataFrame([(i, f"2024-01-01 00:{i:02d}:00") for i in range(20)], "frame long, t string").selectExpr("frame", "cast(t as timestamp) as ts")
    got = live.run_once(spark, live.counts_per_window(stream(spark, df), "ts", "5 minutes", "1 minute")).collect()
    assert [r["n"] for r in sorted(got, key=lambda r: r["start"])] == [5, 5, 5]


def test_from_images_to_tracks(spark):
    o = Optics(z0=50.0, dz=100.0, planes=3, wavelength=0.6, resolution=4.0)
    rows = []
    for f in range(4):
        x = np.zeros((3, 16, 16), complex)
        x[1, 5:7, 4 + f : 6 + f] = 30.0
        rows.append((f, 16, 16, (128 + O.forward(x, o.depths(), o.wavelength, o.resolution)).ravel().tolist()))
    frames = spark.createDataFrame(rows, "frame long, h int, w int, px array<double>")
    s = Settings(start=0, stop=3, optics=o, solver=Solver(l1=0.02, outer=40), segmentation=Segmentation(min_intensity=60.0, min_voxels=2), linking=Linking(maxdisp=4.0, mem=1, good=3))
    out = pipeline.run(frames, s, 16, 16)
    assert out.voxels.count() > 0 and out.objects.select("frame").distinct().count() == 4
    assert out.tracks.select("frame").distinct().count() >= 3


def test_from_a_parameter_file_to_tracks(spark, tmp_path):
    o = Optics(z0=50.0, dz=100.0, planes=3, wavelength=0.6, resolution=4.0)
    rows = []
    for f in range(5):
        x = np.zeros((3, 16, 16), complex)
        x[1, 5:7, 4 + f : 6 + f] = 30.0
        rows.append((f, 16, 16, (128 + O.forward(x, o.depths(), o.wavelength, o.resolution)).ravel().tolist()))
    images = spark.createDataFrame(rows, "frame long, h int, w int, px array<double>")
    sequence.write_sequence(images, f"{tmp_path}/shots", "shot_%05d.tif")
    lines = ["% the run", "N 1001 4", "FROM 1002 0", f"DIR 2002 {tmp_path}/shots/", "NAME 2003 shot_%05d.tif", "Z0 3001 50", "DZ 3002 100", "NZ 3003 3", "LAMBDA 3004 0.6", "DX 3005 4"]
    lines += ["INT 5010 60", "AREA 5009 2", "CLOSE 5011 0", "ITS 6001 40", "TAU 6002 0.02"]
    (tmp_path / "run.txt").write_text("\n".join(lines))
    out = pipeline.run_file(spark, f"{tmp_path}/run.txt", base=Settings(linking=Linking(maxdisp=4.0, mem=1, good=3)))
    assert out.objects.select("frame").distinct().count() == 4 and out.tracks.select("frame").distinct().count() >= 3
    with pytest.raises(ValueError, match="no image 77"):
        (tmp_path / "bad.txt").write_text("\n".join([*lines, "FROM 1002 77"]))
        pipeline.run_file(spark, f"{tmp_path}/bad.txt")


def test_state_of_a_stream_does_not_grow(spark, tmp_path):
    """Batches of a growing folder: results as of whole sequences, state of a few images, late frames dropped."""
    rng = np.random.default_rng(3)
    v = {s: rng.integers(0, 99, 40).astype(float) for s in "ab"}
    put = lambda name, rows: spark.createDataFrame(rows, "seq string, frame long, px array<double>").coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
    old = {k: spark.conf.get(k, None) for k in live.STATE}
    for k, x in live.STATE.items():
        spark.conf.set(k, x)
    rows, sizes = [], []
    try:
        for part in range(4):
            put(f"p{part}", [(s, f, [float(v[s][f]), 1.0]) for s in "ab" for f in range(10 * part, 10 * part + 10)] + ([("a", 3, [999.0, 999.0])] if part == 2 else []))
            src = spark.readStream.schema("seq string, frame long, px array<double>").parquet(f"{tmp_path}/in/*")
            q = live.rolling_background_state(src, "seq").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/mark").trigger(availableNow=True).start(f"{tmp_path}/out")
            q.awaitTermination()
            sizes.append(max(o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"]))
        rows = spark.read.parquet(f"{tmp_path}/out").collect()
    finally:
        for k, x in old.items():
            spark.conf.unset(k) if x is None else spark.conf.set(k, x)
    got = {(r["seq"], r["frame"]): r["px"][0] for r in rows}
    assert got == {(s, i): float(np.median(v[s][i - 4 : i + 1])) for s in "ab" for i in range(4, 40)}
    assert len(set(sizes)) == 1, sizes
