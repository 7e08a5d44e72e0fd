"""The two jobs: growing input, repeated and broken-off runs, and the command line."""

import logging
import re
import shutil
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest


from jobs import enhance_images, sequence_index
from voxtide.operators import frames as fr
from voxtide.operators import runs

ROOT = Path(__file__).resolve().parents[1]


def brute_runs(paths):
    numbers = {}
    for p in paths:
        if p is not None and (m := re.fullmatch(r"(?s)(.*?)(\d+)(\D*)", p)) and int(m[2]) < 2**63:
            numbers.setdefault(f"{m[1]}#{m[3]}", set()).add(int(m[2]))
    out = []
    for pattern, found in numbers.items():
        for i in sorted(found):
            if i - 1 in found:
                out[-1][2] = i
            else:
                out.append([pattern, i, i])
    return sorted((p, a, b, b - a + 1) for p, a, b in out)


def put(spark, folder, name, paths):
    spark.createDataFrame([(p, 1) for p in paths], "url string, bucket int").coalesce(1).write.parquet(f"{folder}-{name}")
    folder.mkdir(exist_ok=True)
    for f in Path(f"{folder}-{name}").glob("part-*.parquet"):
        shutil.copy(f, folder / f"{name}.parquet")


def index(spark, out):
    return sorted((r["pattern"], r["first"], r["last"], r["n"]) for r in sequence_index.read_output(spark, out).collect())


FIRST = [None, "", "no number", "a/shot_0001.tif", "a/shot_0002.tif", "a/shot_0002.tif", "a/shot_0005.tif", "b/7", "x 99999999999999999999", *[f"long_{i}.png" for i in range(65_500, 65_600)]]
SECOND = ["a/shot_0003.tif", "a/shot_0004.tif", "b/9", "c\n12?", *[f"long_{i}.png" for i in range(65_600, 65_620)], *[f"long_{i}.png" for i in range(131_072, 131_080)], "a/shot_0001.tif"]


def test_two_runs_over_growing_input(spark, tmp_path, caplog):
    src, out, mark = tmp_path / "paths", f"{tmp_path}/out", f"{tmp_path}/mark"
    put(spark, src, "one", FIRST)
    (tmp_path / "job.conf").write_text("# few parts\nbuckets = 5\n")
    go = lambda: sequence_index.run(spark, str(src), out, mark, f"{tmp_path}/job.conf")
    with caplog.at_level(logging.INFO, "voxtide.jobs"):
        assert [c["paths"] for c in go()] == [len(FIRST)]
    assert "109 paths read" in caplog.text and "105 indexed" in caplog.text
    assert index(spark, out) == brute_runs(FIRST)
    before = {p: p.stat().st_mtime_ns for p in Path(out).rglob("part-*")}
    assert go() == [] and {p: p.stat().st_mtime_ns for p in Path(out).rglob("part-*")}.items() >= before.items()
    put(spark, src, "two", SECOND)
    assert [c["paths"] for c in go()] == [len(SECOND)]  # only what is new
    assert index(spark, out) == brute_runs(FIRST + SECOND)
    put(spark, src, "three", SECOND)  # the same paths again
    go()
    assert index(spark, out) == brute_runs(FIRST + SECOND)


def test_a_batch_cut_off_is_taken_again(spark, tmp_path, monkeypatch):
    src, out, mark = tmp_path / "paths", f"{tmp_path}/out", f"{tmp_path}/mark"
    put(spark, src, "one", FIRST)
    sequence_index.run(spark, str(src), out, mark)
    put(spark, src, "two", SECOND)
    real, calls = sequence_index.replaced, []

    def stops(rows, path):
        real(rows, path)
        calls.append(path)
        raise RuntimeError("power cut")  # after cells were replaced, before runs were

    monkeypatch.setattr(sequence_index, "replaced", stops)
    with pytest.raises(Exception, match="power cut"):
        sequence_index.run(spark, str(src), out, mark)
    assert calls and calls[0].endswith("cells")
    monkeypatch.setattr(sequence_index, "replaced", real)
    assert len(sequence_index.run(spark, str(src), out, mark)) == 1
    assert index(spark, out) == brute_runs(FIRST + SECOND)


def test_empty_input_and_unknown_settings(spark, tmp_path):
    put(spark, tmp_path / "none", "one", [])
    sequence_index.run(spark, f"{tmp_path}/none", f"{tmp_path}/out", f"{tmp_path}/mark")
    assert index(spark, f"{tmp_path}/out") == []
    (tmp_path / "bad.conf").write_text("bukets = 5\n")
    for job in (sequence_index, enhance_images):
        with pytest.raises(ValueError, match="bukets"):
            job.config_of(spark, f"{tmp_path}/bad.conf")
    for job in (sequence_index, enhance_images):
        shipped = job.config_of(spark, str(ROOT / "jobs" / f"{job.__name__.split('.')[-1]}.conf"))
        assert shipped == job.DEFAULTS


def test_runs_merge_in_any_order(spark, monkeypatch):
    monkeypatch.setattr(runs, "CELL", 8)
    rng = np.random.default_rng(0)
    numbers = [("p" if rng.random() < 0.7 else "q", int(i)) for i in rng.integers(0, 200, 400)]
    some = [spark.createDataFrame(numbers[i::3], "pattern string, number long") for i in range(3)]
    made = runs.merged(runs.as_runs(some[0], "pattern"), "pattern")
    for df in (some[1], some[2], some[1]):
        made = runs.merged(made.unionByName(runs.merged(runs.as_runs(df, "pattern"), "pattern")), "pattern")
    got = sorted((r["pattern"], r["first"], r["last"], r["n"]) for r in runs.joined(made, "pattern").collect())
    assert got == [(p.rstrip("#"), a, b, n) for p, a, b, n in brute_runs([f"{p}{i}" for p, i in numbers])]


def table(spark, folder, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=8).astype(float).tolist(), [3, 3, 3, 5, None][i % 5], "x") for i in range(40)]
    rows += [(100, [0.5] * 8, 7, "x"), (None, [0.0] * 8, 3, "x"), (101, None, 3, "x"), (102, [], 3, "x"), (103, [0.0] * 7, 3, "x"), (104, [None] + [0.0] * 7, 3, "x")]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, px string").write.mode("overwrite").parquet(folder)
    return [r for r in rows if r[0] is not None and r[1] and len(r[1]) == 8 and None not in r[1]]


def expected(rows, frames=None, behind=None):
    grey = {r[0]: np.clip(np.rint(128 + 100 * np.array(r[1])), 0, 255) for r in rows}
    seq = {r[0]: None if r[2] is None else str(r[2]) for r in rows}
    out, known = {}, {}
    for s in set(seq.values()):
        used = [i for i in grey if seq[i] == s and (behind is None or i in behind)]
        if not used:
            continue
        bg = np.mean([grey[i] for i in used], 0)
        rest = [grey[i] - bg for i in used]
        alpha, wide = np.mean([r.mean() for r in rest]) - 5 * np.mean([r.std() for r in rest]), np.mean([r.std() for r in rest])
        beta = 255 / (10 * wide) if wide > 0 else 0
        known[s] = (len(used), bg)
        for i in grey:
            if seq[i] == s and (frames is None or i in frames):
                r = grey[i] - bg
                out[i] = np.clip((r - r.mean() - alpha) * beta, 0, 255)
    return out, known


def test_images_are_enhanced_and_runs_repeat(spark, tmp_path):
    rows = table(spark, f"{tmp_path}/images")
    (tmp_path / "job.conf").write_text("width = 4\n")
    out, want = f"{tmp_path}/out", expected(rows)
    for _ in range(2):
        counts = enhance_images.run(spark, f"{tmp_path}/images", out, f"{tmp_path}/job.conf")
        assert counts == {"read": 46, "used": 41, "backgrounds": 4, "images": 41}
        backgrounds, images = enhance_images.read_output(spark, out)
        got = {r["frame"]: r for r in images.collect()}
        assert got.keys() == want[0].keys() and {(r["h"], r["w"]) for r in got.values()} == {(2, 4)}
        for i, r in got.items():
            assert np.allclose(r["px"], want[0][i])
        for r in backgrounds.collect():
            assert r["n"] == want[1][r["sequence"]][0] and np.allclose(r["bg"], want[1][r["sequence"]][1])
    # a sequence that comes again replaces itself alone
    spark.read.parquet(f"{tmp_path}/images").filter("label = 5").write.parquet(f"{tmp_path}/five")
    assert enhance_images.run(spark, f"{tmp_path}/five", out, f"{tmp_path}/job.conf")["images"] == 41


def test_images_chosen_by_a_parameter_file(spark, tmp_path):
    rows = table(spark, f"{tmp_path}/images")
    (tmp_path / "p.txt").write_text("% which images\nSTART 1002 10\nNUM 1001 15\nBG_START 1003 5\nBG_END 1004 30\n")
    enhance_images.run(spark, f"{tmp_path}/images", f"{tmp_path}/out", None, f"{tmp_path}/p.txt")
    want, _ = expected(rows, range(10, 25), range(5, 31))
    got = {r["frame"]: r["px"] for r in enhance_images.read_output(spark, f"{tmp_path}/out")[1].collect()}
    assert got.keys() == want.keys() and all(np.allclose(px, want[i]) for i, px in got.items())


def test_backgrounds_join_both_ways(spark, tmp_path):
    table(spark, f"{tmp_path}/images")
    f = enhance_images.images_of(spark.read.parquet(f"{tmp_path}/images"), enhance_images.DEFAULTS)
    means = enhance_images.materialize(fr.sequence_backgrounds(f, "sequence"), "t")
    near, far = (sorted(map(str, fr.sequence_stats(f, means, "sequence", broadcast_bytes=n).collect())) for n in (10**6, 0))
    assert near == far and len(near) == 4
    one, two = (sorted((r["frame"], round(sum(r["bg"]), 6)) for r in fr.with_sequence_background(f, means, "sequence", n).collect()) for n in (10**6, 0))
    assert one == two and len(one) == 41


def test_images_of_two_sizes_are_an_error(spark, tmp_path):
    spark.createDataFrame([(1, [0.0] * 8, 1), (2, [0.0] * 16, 1)], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/images")
    with pytest.raises(ValueError, match="size"):
        enhance_images.run(spark, f"{tmp_path}/images", f"{tmp_path}/out")


def test_command_line(tmp_path, spark):
    put(spark, tmp_path / "paths", "one", FIRST)
    args = [sys.executable, str(ROOT / "jobs" / "sequence_index.py"), "--paths", f"{tmp_path}/paths", "--output", f"{tmp_path}/out", "--checkpoint", f"{tmp_path}/mark", "--config", str(ROOT / "jobs" / "sequence_index.conf")]
    done = subprocess.run(["timeout", "300", *args], capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-2000:]
    assert f"{len(FIRST)} paths read" in done.stderr
    assert index(spark, f"{tmp_path}/out") == brute_runs(FIRST)


def test_jobs_import_nothing_of_the_text_operators():
    for f in [*(ROOT / "jobs").glob("*.py"), Path(__file__)]:
        assert not re.search(r"^\s*(?:from|import)\s+(?:voxtide\.llm|corpus_pipeline)", f.read_text(), re.M)
