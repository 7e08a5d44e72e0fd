"""Regions of image files, of which only the bytes are read that regions touch.

A TIFF says where its strips lie. Of an uncompressed strip only the lines of a region are read, of a packed one the
strip, and strips without a region aren't. Files are found by number as in `sequence`, without their content; a task has the
points of one file and reads a region at a time. PNG files have no such index and are read whole.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import qualified, ship
from .images import _unpacked_runs, unpng
from .sequence import scan_sequence, store_of

#: Reads `n` bytes from a place in a file.
Reader = Callable[[int, int], bytes]
#: Values of regions that are held before rows are sent on.
HELD = 2**16
_SIZES = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4)}


class Strips:
    """Where the lines of a grey TIFF lie, from its header and tags alone."""

    def __init__(self, read: Reader):
        head = read(0, 8)
        if head[:4] not in (b"II*\0", b"MM\0*"):
            raise ValueError("not a TIFF file")
        self.read, e = read, "<" if head[:2] == b"II" else ">"
        at = struct.unpack(e + "I", head[4:])[0]
        count = struct.unpack(e + "H", read(at, 2))[0]
        entries, tags = read(at + 2, 12 * count), {}
        for k in range(count):
            tag, kind, n = struct.unpack_from(e + "HHI", entries, 12 * k)
            if kind in _SIZES:
                form, size = _SIZES[kind]
                raw = entries[12 * k + 8 : 12 * k + 8 + size * n] if size * n <= 4 else read(struct.unpack_from(e + "I", entries, 12 * k + 8)[0], size * n)
                tags[tag] = struct.unpack(f"{e}{n}{form}", raw[: size * n])
        one = lambda tag, default: tags.get(tag, (default,))[0]
        self.w, self.h, depth, self.packing = one(256, 0), one(257, 0), one(258, 1), one(259, 1)
        if depth not in (8, 16) or self.packing not in (1, 8, 32773, 32946) or one(277, 1) != 1 or one(317, 1) != 1 or one(262, 1) > 1:
            raise ValueError("regions are read of grey TIFFs of 8 or 16 bits in strips, plain, deflated or run-length packed")
        self.kind, self.white = np.dtype(e + ("u2" if depth == 16 else "u1")), 2**depth - 1 if one(262, 1) == 0 else None
        self.lines = min(one(278, self.h), self.h) or 1
        self.offsets, self.bytes = tags[273], tags[279]
        self.held: dict[int, np.ndarray] = {}

    def strip(self, k: int) -> np.ndarray:
        """The values of a packed strip; the last one unpacked is kept, as neighbouring lines are asked for in turn."""
        if k not in self.held:
            unpack = {8: zlib.decompress, 32946: zlib.decompress, 32773: _unpacked_runs}[self.packing]
            self.held = {k: np.frombuffer(unpack(self.read(self.offsets[k], self.bytes[k])), self.kind)}
        return self.held[k]

    def rows(self, first: int, last: int) -> np.ndarray:
        """Lines first..last-1."""
        out = []
        for k in range(first // self.lines, -(-last // self.lines)):
            a, b = max(first - k * self.lines, 0), min(last - k * self.lines, self.lines)
            if self.packing == 1:
                step = self.w * self.kind.itemsize
                values = np.frombuffer(self.read(self.offsets[k] + a * step, (b - a) * step), self.kind)
            else:
                values = self.strip(k)[a * self.w : b * self.w]
            out.append(values.reshape(b - a, self.w))
        values = np.concatenate(out).astype(float)
        return self.white - values if self.white is not None else values

    def region(self, x0: int, y0: int, size: int) -> np.ndarray:
        """A square from (x0, y0); what lies outside the image is 0."""
        out = np.zeros((size, size))
        top, bottom, left, right = max(y0, 0), min(y0 + size, self.h), max(x0, 0), min(x0 + size, self.w)
        if top < bottom and left < right:
            out[top - y0 : bottom - y0, left - x0 : right - x0] = self.rows(top, bottom)[:, left:right]
        return out


def cut_out(image: np.ndarray, x0: int, y0: int, size: int) -> np.ndarray:
    out = np.zeros((size, size))
    h, w = image.shape
    top, bottom, left, right = max(y0, 0), min(y0 + size, h), max(x0, 0), min(x0 + size, w)
    if top < bottom and left < right:
        out[top - y0 : bottom - y0, left - x0 : right - x0] = image[top:bottom, left:right]
    return out


def read_regions(spark: SparkSession, path: str, points: DataFrame, size: int) -> DataFrame:
    """(frame, part, h, w, px, bytes_read): what `operators.frames.regions` gives for the images of a path, and how many bytes of a region's file were read for it. Points (frame, part, x, y) of frames without a file are left out."""
    ship(spark)
    half = size // 2
    at = points.select(F.col("frame").cast("long").alias("frame"), F.col("part").cast("long").alias("part"), *[(F.floor(F.col(c) + 0.5) - half).cast("int").alias(f"{c}0") for c in "xy"])
    # neighbouring lines in turn, so that a packed strip is unpacked once
    grouped = at.groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("y0", "x0", "part"))).alias("points"))
    # the source plans a few files a task, as if they were opened there; here only their names are taken
    files = scan_sequence(spark, path).select("frame", "path", "length").coalesce(int(spark.conf.get("spark.sql.shuffle.partitions")))
    home = qualified(spark, "/").rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # regions of many files are sent together
        rows: list[tuple] = []

        def sent() -> pa.RecordBatch:
            n = len(rows)
            frame, part, taken, px = zip(*rows, strict=True)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * size * size), pa.array(np.concatenate(px)))
            side = pa.array(np.full(n, size, np.int32))
            return pa.RecordBatch.from_arrays([pa.array(frame, pa.int64()), pa.array(part, pa.int64()), side, side, flat, pa.array(taken, pa.int64())], ["frame", "part", "h", "w", "px", "bytes_read"])

        for batch in batches:
            found = batch.column("points")
            ends, y0, x0, part = found.offsets.to_pylist(), *(found.values.field(c).to_pylist() for c in ("y0", "x0", "part"))
            for k, (frame, name, length) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("frame", "path", "length")), strict=True)):
                name = name if ":/" in name else home + name
                store, where = store_of(name)
                taken = 0
                with store.open_input_file(where) as f:

                    def read(start: int, n: int, f=f) -> bytes:
                        nonlocal taken
                        taken += n
                        f.seek(start)
                        return f.read(n)

                    if name.lower().endswith(".png"):
                        image = unpng(read(0, int(length)))
                        make = lambda x, y, image=image: cut_out(image, x, y, size)
                    else:
                        strips = Strips(read)
                        make = lambda x, y, strips=strips: strips.region(x, y, size)
                    for i in range(ends[k], ends[k + 1]):
                        px = make(x0[i], y0[i]).ravel()
                        rows.append((frame, part[i], taken, px))
                        taken = 0
                        if len(rows) * size * size >= HELD:
                            yield sent()
                            rows.clear()
        if rows:
            yield sent()

    return files.join(grouped, "frame").mapInArrow(run, "frame long, part long, h int, w int, px array<double>, bytes_read long")
