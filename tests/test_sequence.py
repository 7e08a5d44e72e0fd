"""The image sequence source and its writer, and parameter files."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from voxtide import config
from voxtide.sources import images, parameters, sequence


def put(folder, frames, name="shot_{:05d}.tif", shape=(3, 4)):
    rng = np.random.default_rng(0)
    made = {}
    for i in frames:
        made[i] = rng.integers(1, 255, shape).astype(np.uint8)
        (folder / name.format(i)).write_bytes(images.tiff(made[i]) if name.endswith("tif") else images.png(made[i]))
    return made


def test_only_wanted_files_are_opened(spark, tmp_path):
    made = put(tmp_path, range(5, 12))
    for i in (1, 2, 3, 40):
        (tmp_path / f"shot_{i:05d}.tif").write_bytes(b"not an image")  # an error, if it were opened
    (tmp_path / "notes.txt").write_text("7")
    df = sequence.read_sequence(spark, str(tmp_path))
    got = {r["frame"]: r for r in df.filter("frame >= 5 and frame < 20").collect()}
    assert sorted(got) == list(range(5, 12))
    for i, r in got.items():
        assert (np.array(r["px"]).reshape(r["h"], r["w"]) == made[i]).all()
    assert {r["frame"] for r in df.filter(F.col("frame").isin(6, 9, 90)).collect()} == {6, 9}
    assert df.filter("frame = 7 and h = 3").select("w").collect()[0][0] == 4
    assert df.filter("frame > 5 and frame <= 10 and frame in (3, 6)").count() == 1
    assert df.filter("frame > 40").count() == 0
    # a scan of some frames leaves others of the same DataFrame whole
    assert {r[0] for r in df.filter("frame < 8 and frame > 4").join(df.filter("frame between 6 and 11"), "frame").select("frame").collect()} == {6, 7}
    some = df.filter("frame >= 5 and frame < 20")
    some.collect()
    scan = some._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.metrics().apply("numFiles").value() == 7
    with pytest.raises(Exception, match="not a TIFF"):
        df.select("h").collect()


def test_pattern_of_names_and_load_modes(spark, tmp_path):
    made = put(tmp_path, range(4), "a_{:02d}.png")
    put(tmp_path, range(4), "b_{:02d}.png", (2, 2))
    background = np.full((3, 4), 50, np.uint8)
    background[0, 0] = 0
    row = spark.createDataFrame([(background.astype(float).ravel().tolist(),)], "px array<double>")
    plain = {"inverse": lambda v: 1 - v / v.mean(), "mean0": lambda v: v / v.mean() - 1, "normalize": lambda v: v / v.mean(), "unit": lambda v: v / 255}
    plain["divide"] = lambda v: np.where(background == 0, 0, v / np.maximum(background, 1) - 1)
    plain["subtract"] = lambda v: np.clip((v - background - (v - background.astype(float)).mean() - 3) * 2 + 1, 0, 255)
    for how, want in plain.items():
        df = sequence.read_sequence(spark, f"{tmp_path}/a_*.png", how, row if how in ("divide", "subtract") else None, alpha=3, beta=2, low=1)
        got = {r["frame"]: np.array(r["px"]).reshape(3, 4) for r in df.collect()}
        assert sorted(got) == [0, 1, 2, 3]
        for i, px in got.items():
            assert np.allclose(px, want(made[i].astype(float))), how
    with pytest.raises(ValueError):
        sequence.read_sequence(spark, str(tmp_path), "odd")
    with pytest.raises(ValueError):
        sequence.read_sequence(spark, str(tmp_path), "divide")


def test_partitions_follow_bytes(spark, tmp_path):
    put(tmp_path, range(40))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    size = (tmp_path / "shot_00000.tif").stat().st_size
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 5 * size)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        df = sequence.read_sequence(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() == 8 and df.filter("frame < 10").rdd.getNumPartitions() < 8
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    empty = tmp_path / "none"
    empty.mkdir()
    assert sequence.read_sequence(spark, str(empty)).count() == 0


def test_written_files_come_back(spark, tmp_path):
    rows = [(i, 2, 3, [float(i * 6 + k) for k in range(6)]) for i in range(30)]
    frames = spark.createDataFrame(rows, "frame long, h int, w int, px array<double>").repartition(4)
    for name in ("frame_%06d.tif", "s%03d.png"):
        folder = tmp_path / name[:3]
        for _ in range(2):  # written again, the files are the same
            sequence.write_sequence(frames, str(folder), name)
        assert sorted(p.name for p in folder.iterdir()) == [name % i for i in range(30)]
        assert {r["frame"]: r["px"] for r in sequence.read_sequence(spark, str(folder)).collect()} == {r[0]: r[3] for r in rows}
    sequence.write_sequence(frames.filter("frame = 1"), str(tmp_path / "scaled"), scale=(6, 11))
    assert sequence.read_sequence(spark, str(tmp_path / "scaled")).collect()[0]["px"] == [0, 51, 102, 153, 204, 255]


def test_a_job_that_fails_leaves_no_file(spark, tmp_path):
    rows = [(i, 1, 2, [1.0, 2.0]) for i in range(12)]
    frames = spark.createDataFrame(rows, "frame long, h int, w int, px array<double>").repartitionByRange(4, "frame")
    bad = frames.withColumn("h", F.when(F.col("frame") == 11, F.raise_error(F.lit("killed half-way")).cast("int")).otherwise(F.col("h")))
    with pytest.raises(Exception, match="killed half-way"):
        sequence.write_sequence(bad, str(tmp_path / "out"))
    assert [p for p in (tmp_path / "out").rglob("*") if p.is_file()] == [] if (tmp_path / "out").exists() else True


def test_parameter_file(spark, tmp_path):
    text = "% a remark\n# another\n\nNUM_IMAGES 1001 40 images\r\nSTART 1002 3\nBG_START 1003 1\nBG 1004 30\nPATH 2002 /data/run 1/\nNAME 2003 shot_%05d.tif\tand a remark\nDZ 3002 2000\nLAMBDA 3004 632.5e0 nm\nNZ 3003 4\nNZ 3003 5\nTV 6004 .5\nFLAG 7002 true\nFLAG 7003 0\nBETA 4001 -0.25\n"
    (tmp_path / "p.txt").write_text(text)
    got = parameters.load_settings(spark, str(tmp_path / "p.txt"), unit=0.001)
    assert (got.start, got.stop, got.background_start, got.background_stop) == (3, 42, 1, 30)
    assert got.image_pattern == "/data/run 1/shot_%05d.tif"
    assert (got.optics.dz, round(got.optics.wavelength, 9), got.optics.planes, got.solver.tv) == (2.0, 0.6325, 5, 0.5)
    assert got.other == {"INPUT_PATHN": "/data/run 1/", "INPUT_FORMATFN": "shot_%05d.tif", "STANDARD_RECON": True, "INVERSE_RECON": False, "BETA": -0.25}
    parameters.write_parameters(spark, got, str(tmp_path / "back"), unit=0.001)
    assert parameters.load_settings(spark, str(tmp_path / "back"), unit=0.001) == got
    assert len({p.code for p in parameters.CODES}) == len(parameters.CODES) == len({p.name for p in parameters.CODES})


def test_broken_parameter_lines(spark, tmp_path):
    (tmp_path / "p.txt").write_text("one two three\nX 99 3\nNZ 3003 4.5\nNZ 3003 many\nF 7001 perhaps\nNZ 3003\nNZ 3003 7\n")
    rows = parameters.read_parameters(spark, str(tmp_path / "p.txt")).orderBy("line").collect()
    assert [r["broken"] for r in rows] == ["not a name, a code and a value", "no such code", "not a whole number", "not a number", "not a flag", "not a name, a code and a value", None]
    assert [r["line"] for r in rows] == [1, 2, 3, 4, 5, 6, 7] and rows[-1]["number"] == 7
    assert parameters.load_settings(spark, str(tmp_path / "p.txt"), "PERMISSIVE") == config.Settings(optics=config.Optics(planes=7))
    with pytest.raises(Exception, match="no such code|not a"):
        parameters.load_settings(spark, str(tmp_path / "p.txt"))
    wide = parameters.settings_columns(parameters.read_parameters(spark, str(tmp_path)), "NUM_PLANES", "BETA").collect()
    assert [(r["NUM_PLANES"], r["BETA"]) for r in wide] == [("7.0", None)]


def test_planes_as_images(spark, tmp_path):
    from voxtide.sources import sinks

    rng = np.random.default_rng(2)
    rows = [(f, z, 3, 4, rng.normal(size=12).tolist(), rng.normal(size=12).tolist()) for f in range(3) for z in range(5)] + [(9, 0, 1, 2, [1.0, 1.0], [0.0, 0.0])]
    planes = spark.createDataFrame(rows, "frame long, z_idx int, h int, w int, re array<double>, im array<double>")
    sinks.write_planes(planes, str(tmp_path / "c"))
    values = {(f, z): np.array(re) + 1j * np.array(im) for f, z, _, _, re, im in rows}
    span = {f: (min(np.abs(v).min() for (g, _), v in values.items() if g == f), max(np.abs(v).max() for (g, _), v in values.items() if g == f)) for f in (0, 1, 2, 9)}
    mag = {(r["frame"], r["z_idx"]): r["px"] for r in sinks.read_planes(spark, str(tmp_path / "c")).collect()}
    phase = {(r["frame"], r["z_idx"]): r["px"] for r in sinks.read_planes(spark, str(tmp_path / "c"), "phase_plane").collect()}
    assert mag.keys() == phase.keys() == values.keys()
    for (f, z), v in values.items():
        lo, hi = span[f]
        assert mag[f, z] == (np.rint((np.abs(v) - lo) / (hi - lo) * 255).tolist() if hi > lo else [0.0, 0.0])
        assert phase[f, z] == np.rint(np.abs(np.mod(np.angle(v), 2 * np.pi) - np.pi) / np.pi * 255).tolist()
    sinks.write_planes(planes.withColumn("re", F.transform("re", lambda x: F.abs(x) / 4)), str(tmp_path / "r"), real=True, prefix="est_")
    real = {(r["frame"], r["z_idx"]): r["px"] for r in sinks.read_planes(spark, str(tmp_path / "r"), prefix="est_").collect()}
    assert real[1, 2] == np.clip(np.rint(np.abs(values[1, 2].real) / 4 * 255), 0, 255).tolist()


def test_tables_of_frames(spark, tmp_path):
    from voxtide.sources import sinks

    metrics = [(f, i, 1.5 / (i + 1), 0.25, 2.0**-i, i) for f in range(3) for i in range(4)]
    df = spark.createDataFrame(metrics, "frame long, it int, f double, sparsity double, stepsize double, total_backtracks int")
    for part in (df, df.filter("frame = 1")):  # a frame written again replaces only itself
        sinks.write_metrics(part, str(tmp_path / "m"))
    assert sorted(map(tuple, sinks.read_metrics(spark, str(tmp_path / "m")).collect())) == metrics
    focus = [(f, z, -1234.5678 * (z + 1), 1e-7 * f) for f in range(2) for z in range(12)]
    sinks.write_focus_text(spark.createDataFrame(focus, "frame long, z_idx int, raw_real double, raw_imag double").repartition(3), str(tmp_path / "f"))
    got = sorted(map(tuple, sinks.read_focus_text(spark, str(tmp_path / "f")).collect()))
    assert [g[:2] for g in got] == [w[:2] for w in focus] and np.allclose([g[2:] for g in got], [w[2:] for w in focus], rtol=1e-6)
    line = next((tmp_path / "f").glob("frame=0/*.txt")).read_text().splitlines()[1]
    assert line == "   -2.4691356E+03   0.0000000E+00"
    planes = spark.createDataFrame([(4, 2, 2, 2, [0.0, 1.5, 0.0, -2.0])], "frame long, z_idx int, h int, w int, re array<double>")
    sinks.write_nonzeros(planes, str(tmp_path / "n"))
    assert sorted(map(tuple, sinks.read_nonzeros(spark, str(tmp_path / "n")).collect())) == [(4, 1, 0, 2, 1.5), (4, 1, 1, 2, -2.0)]
    assert next((tmp_path / "n").glob("frame=4/*.csv")).read_text().splitlines()[:2] == ["x, y, z, value", "1,0,2,1.500000"]
