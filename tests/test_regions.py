"""Regions read from files, and how much of the files is read."""

import struct
import zlib

import numpy as np
import pytest
from voxtide.operators import frames as fr
from voxtide.sources import images, regions


def strip_tiff(a, lines, packing=1, order="<"):
    """A grey TIFF in strips of some lines."""
    kind = np.dtype(order + ("u2" if a.dtype == np.uint16 else "u1"))
    parts = [a[k : k + lines].astype(kind).tobytes() for k in range(0, len(a), lines)]
    parts = [zlib.compress(p) if packing == 8 else p for p in parts]
    offsets, at = [], 8
    for p in parts:
        offsets.append(at)
        at += len(p)
    tail = at + at % 2
    n, tags = len(parts), [(256, 4, [a.shape[1]]), (257, 4, [a.shape[0]]), (258, 3, [kind.itemsize * 8]), (259, 3, [packing]), (262, 3, [1])]
    tags += [(273, 4, offsets), (277, 3, [1]), (278, 4, [lines]), (279, 4, [len(p) for p in parts])]
    after, lists, entries = tail + 2 + 12 * len(tags) + 4, b"", b""
    for tag, form, values in tags:
        raw = struct.pack(f"{order}{len(values)}{'H' if form == 3 else 'I'}", *values)
        if len(raw) > 4:
            raw, lists = struct.pack(order + "I", after + len(lists)), lists + raw
        entries += struct.pack(order + "HHI", tag, form, len(values)) + raw.ljust(4, b"\0")
    assert n == len(offsets)
    head = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", tail)
    return head + b"".join(parts) + b"\0" * (at % 2) + struct.pack(order + "H", len(tags)) + entries + struct.pack(order + "I", 0) + lists


def test_regions_are_those_of_whole_images(spark, tmp_path):
    rng = np.random.default_rng(0)
    a = [rng.integers(0, 255, (40, 50)).astype(np.uint8 if i % 2 else np.uint16) for i in range(5)]
    made = [strip_tiff(a[0], 7), strip_tiff(a[1], 7, 8), strip_tiff(a[2], 16, 1, ">"), images.tiff(a[3]), images.png(a[4])]
    for i, data in enumerate(made):
        (tmp_path / f"f{i:03d}.{'png' if i == 4 else 'tif'}").write_bytes(data)
    assert all((images.decoded(d) == x).all() for d, x in zip(made, a, strict=True))
    rows = [(i, k, float(x), float(y)) for i in range(6) for k, (x, y) in enumerate([(25, 20), (0, 0), (49.6, 39.4), (-9, 5), (3, 38), (300, 300)])]
    points = spark.createDataFrame(rows, "frame long, part long, x double, y double")
    whole = spark.createDataFrame([(i, 40, 50, x.astype(float).ravel().tolist()) for i, x in enumerate(a)], "frame long, h int, w int, px array<double>")
    want = {(r["frame"], r["part"]): r["px"] for r in fr.regions(whole, points, 8).collect()}
    got = {(r["frame"], r["part"]): r["px"] for r in regions.read_regions(spark, str(tmp_path), points, 8).collect()}
    assert got == want and len(got) == 30


def test_bytes_read_are_in_proportion_to_regions(spark, tmp_path):
    a = np.arange(2000 * 100, dtype=np.uint32).reshape(2000, 100).astype(np.uint8)
    (tmp_path / "f1.tif").write_bytes(images.tiff(a))
    (tmp_path / "f2.tif").write_bytes(strip_tiff(a, 10, 8))
    points = spark.createDataFrame([(f, k, 50.0, 100.0 + 300 * k) for f in (1, 2) for k in range(4)], "frame long, part long, x double, y double")
    got = regions.read_regions(spark, str(tmp_path), points, 10)
    read = {r["frame"]: r["sum(bytes_read)"] for r in got.groupBy("frame").sum("bytes_read").collect()}
    assert 4 * 10 * 100 <= read[1] < 4 * 10 * 100 + 500  # the lines of four regions, and the tags
    assert read[2] < (tmp_path / "f2.tif").stat().st_size / 5


def test_other_files_are_refused():
    for data in (b"GIF89a  ", b"II*\0\x08\0\0\0\0\0"):
        with pytest.raises((ValueError, KeyError)):
            regions.Strips(lambda at, n, data=data: data[at : at + n])
