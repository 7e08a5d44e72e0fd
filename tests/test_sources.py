import numpy as np
import pytest
from pyspark.sql import functions as F
from voxtide import config, schemas
from voxtide.sources import files, images


def test_png_round_trip():
    rng = np.random.default_rng(0)
    for kind in (np.uint8, np.uint16):
        a = rng.integers(0, np.iinfo(kind).max, (7, 5)).astype(kind)
        assert (images.unpng(images.png(a)) == a).all()
    with pytest.raises(ValueError):
        images.unpng(b"GIF89a")


def test_tiff_round_trip():
    rng = np.random.default_rng(0)
    for kind in (np.uint8, np.uint16):
        a = rng.integers(0, np.iinfo(kind).max, (7, 5)).astype(kind)
        assert (images.untiff(images.tiff(a)) == a).all() and (images.decoded(images.tiff(a)) == a).all()
    # big-endian, two strips, run lengths
    rows = [bytes([255, 9, 1, 1, 2]), bytes([254, 7, 0, 3])]
    tags = [(256, 3, [4]), (257, 3, [2]), (258, 3, [8]), (259, 3, [32773]), (262, 3, [1]), (273, 4, [8, 13]), (277, 3, [1]), (278, 3, [1]), (279, 4, [5, 4])]
    import struct

    at, extra = 18, 18 + 2 + 12 * len(tags) + 4
    body, tail = b"", b""
    for tag, kind, values in tags:
        if len(values) == 1:
            body += struct.pack(">HHI", tag, kind, 1) + (struct.pack(">HH", values[0], 0) if kind == 3 else struct.pack(">I", values[0]))
        else:
            body += struct.pack(">HHII", tag, kind, 2, extra + len(tail))
            tail += struct.pack(">II", *values)
    data = b"MM\0*" + struct.pack(">I", at) + b"".join(rows) + b"\0" + struct.pack(">H", len(tags)) + body + struct.pack(">I", 0) + tail
    assert images.untiff(data).tolist() == [[9, 9, 1, 2], [7, 7, 7, 3]]
    with pytest.raises(ValueError):
        images.decoded(b"GIF89a")


def test_filtered_png_lines():
    """The five filters of lines, undone byte by byte."""
    import struct
    import zlib

    rng = np.random.default_rng(1)
    h, w, step = 10, 6, 3
    raw = rng.integers(0, 256, (h, 1 + w * step)).astype(np.uint8)
    raw[:, 0] = [0, 1, 2, 3, 4, 4, 3, 2, 1, 0]
    plain = np.zeros((h, w * step), int)
    for y in range(h):
        for i in range(w * step):
            a, b = (plain[y, i - step] if i >= step else 0), (plain[y - 1, i] if y else 0)
            c = plain[y - 1, i - step] if y and i >= step else 0
            p = a + b - c
            nearest = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            plain[y, i] = (int(raw[y, 1 + i]) + [0, a, b, (a + b) // 2, nearest][raw[y, 0]]) % 256
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    data = b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw.tobytes())) + part(b"IEND", b"")
    assert np.allclose(images.unpng(data), plain.reshape(h, w, 3) @ np.array(images.GREY[::-1]))


def test_sequence_of_images(spark, tmp_path):
    frames = spark.createDataFrame([(i, 3, 4, [float(20 * i + k) for k in range(12)]) for i in range(6)], "frame long, h int, w int, px array<double>")
    assert images.write_frames(frames, str(tmp_path)) == 6
    got = images.read_frames(spark, f"{tmp_path}/*.png", start=1, stop=5, step=2)
    rows = {r["frame"]: r for r in got.collect()}
    assert sorted(rows) == [1, 3, 5] and rows[3]["px"] == [60.0 + k for k in range(12)] and (rows[3]["h"], rows[3]["w"]) == (3, 4)
    other = {r["frame"]: r["px"] for r in images.read_images(spark, str(tmp_path)).collect()}
    assert other[3] == rows[3]["px"]
    found = images.discover(spark.createDataFrame([("a/b_2/img_007.png",), ("a/b_2/img_010.png",), ("x.png",)], "path string")).collect()
    assert [(r["pattern"], r["first"], r["last"]) for r in found] == [("a/b_2/img_#.png", 7, 10)]
    assert images.write_frames(frames, f"file://{tmp_path}/t", name="im_{:04d}.tif") == 6
    assert {r["frame"]: r["px"] for r in images.read_frames(spark, f"{tmp_path}/t/*.tif").collect()}[3] == rows[3]["px"]
    small = images.resampled(frames, 4, 2).filter("frame = 0").first()["px"]
    assert len(small) == 8 and np.isclose(np.mean(small[4:][-1]), np.mean(range(12)), atol=6)


def test_voxel_files(spark, tmp_path):
    v = spark.createDataFrame([(0, 0, 1, 2, 3.0, 4.0), (0, 2, 0, 0, 2.0, 0.0)], schemas.VOXELS)
    files.write_lines(files.voxel_file(v), f"{tmp_path}/voxels_0003", schemas.VOXEL_HEADER)
    rows = sorted((r["z"], r["y"], r["x"], r["re"]) for r in files.read_voxels(spark, f"{tmp_path}/voxels_0003").collect())
    assert rows == [(0, 1, 2, 5.0), (2, 0, 0, 2.0)]
    with pytest.raises(Exception, match="outside"):
        files.read_voxels(spark, f"{tmp_path}/voxels_0003", 2, 2).collect()


def test_centroid_and_track_files(spark, tmp_path):
    (tmp_path / "centroids_0012.csv").write_text(schemas.CENTROID_HEADER + "\n1.5, 2,3 , 7\n\nx,y\n4,bad,6,9\n")
    rows = files.read_centroids(spark, f"{tmp_path}/centroids_*.csv").orderBy("x").collect()
    assert [tuple(r) for r in rows] == [(12, 1.5, 2.0, 3.0, 7.0), (12, 4.0, None, 6.0, 9.0)]
    (tmp_path / "t.csv").write_text("x,y,z,frame,ID\n1,2,3,0,1\n1;2;3;1;1\n1\t2\t3\t2\t2\nshort,1\n")
    assert [(r["frame"], r["id"]) for r in files.read_tracks(spark, f"{tmp_path}/t.csv").orderBy("frame").collect()] == [(0, 1), (1, 1), (2, 2)]


def test_points_matrices_focus(spark, tmp_path):
    (tmp_path / "p.txt").write_text("0 1 1 5\n0 2 3 6\n1.5 4 4 7\n")
    got = files.read_points2d(spark, f"{tmp_path}/p.txt").orderBy("frame", "part").collect()
    assert [(r["frame"], r["part"], r["x"], r["y"], r["size"]) for r in got] == [(0, 0, 0, 0, 5), (0, 1, 1, 2, 6), (1, 0, 3, 3, 7)]
    back = files.points2d_lines(files.read_points2d(spark, f"{tmp_path}/p.txt")).collect()
    assert sorted(back[0]["value"].split()) and len(back[0]["value"]) == 64
    (tmp_path / "bad.txt").write_text("1 1 1 5\n0 2 3 6\n")
    with pytest.raises(Exception, match="decrease"):
        files.read_points2d(spark, f"{tmp_path}/bad.txt").collect()
    (tmp_path / "m.txt").write_text("   1.0 2.5\n  3 4\n")
    assert [r["cells"] for r in files.read_matrix(spark, f"{tmp_path}/m.txt").orderBy("line").collect()] == [[1.0, 2.5], [3.0, 4.0]]
    a = np.array([[1.0, -2.5], [3e-9, 4.0]])
    assert np.allclose(files.read_matrix_yaml(files.matrix_yaml("m", a)), a)
    (tmp_path / "focus.bin").write_bytes(files.focus_bytes([(1.5, -2.0), (3.0, 4.0)]))
    assert [(r["z_idx"], r["raw_real"], r["raw_imag"]) for r in files.read_focus(spark, f"{tmp_path}/focus.bin").orderBy("z_idx").collect()] == [(0, 1.5, -2.0), (1, 3.0, 4.0)]
    assert files.points_per_frame(files.read_points2d(spark, f"{tmp_path}/p.txt")).orderBy("frame").collect()[0]["n"] == 2


def test_settings(spark, tmp_path):
    assert config.read_coded("a 1 x y\n% note\nb 2 3 # note\n\n") == [("a", 1, "x y"), ("b", 2, "3")]
    with pytest.raises(ValueError):
        config.read_coded("a b c\n")
    pairs = config.read_pairs("# no\nmaxdisp = 4.5\nmemory=3\nbroken\n =x\n")
    assert pairs == {"maxdisp": "4.5", "memory": "3"}
    assert config.linking_from_pairs(pairs) == config.Linking(maxdisp=4.5, mem=3)
    s = config.Settings(start=3, optics=config.Optics(planes=4, dz=2.0, z0=1.0))
    assert config.Settings.from_json(s.to_json()) == s and s.optics.depths() == [1.0, 3.0, 5.0, 7.0]
    (tmp_path / "kv.txt").write_text("a = 1 = 2\n#c = 3\nno\n")
    assert [(r["key"], r["value"]) for r in files.read_pairs(spark, f"{tmp_path}/kv.txt").collect()] == [("a", "1 = 2")]
    (tmp_path / "state.json").write_text(s.to_json())
    assert files.read_state(spark, f"{tmp_path}/state.json").select(F.col("optics.planes")).first()[0] == 4
