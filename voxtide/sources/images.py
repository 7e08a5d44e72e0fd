"""Grey images as frames, and frames as PNG or TIFF files."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.arrays import last_number
from ..tables import ship

GREY = (0.114, 0.587, 0.299)  # blue, green, red


def png(image: np.ndarray) -> bytes:
    """An 8- or 16-bit grey image as PNG."""
    deep = image.dtype == np.uint16
    h, w = image.shape
    rows = image.astype(">u2" if deep else np.uint8)
    raw = b"".join(b"\0" + r.tobytes() for r in rows)
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 16 if deep else 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw, 1)) + part(b"IEND", b"")


def unpng(data: bytes) -> np.ndarray:
    """Grey values of a PNG without interlacing or palette, 8 or 16 bits; colour is weighed to grey, and alpha is left out."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, packed = 8, []
    w = h = depth = colour = 0
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            w, h, depth, colour, _, _, lace = struct.unpack(">IIBBBBB", body)
            if depth not in (8, 16) or colour not in (0, 2, 4, 6) or lace:
                raise ValueError("only grey and true-colour PNGs of 8 or 16 bits without interlacing are read")
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    channels = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
    step = channels * depth // 8
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(h, 1 + w * step)
    out = np.zeros((h, w * step), np.uint8)
    above = np.zeros(w * step, np.int64)
    for y in range(h):
        line, kind = raw[y, 1:].astype(np.int64), raw[y, 0]
        if kind == 2:
            line = (line + above) & 255
        elif kind == 1:
            line = np.cumsum(line.reshape(w, step), axis=0).ravel() & 255
        elif kind in (3, 4):
            # each pixel needs the one before it; the bytes of a pixel go together
            ahead, left, corner = line.reshape(w, step), np.zeros(step, np.int64), np.zeros(step, np.int64)
            made, over = np.empty((w, step), np.int64), above.reshape(w, step)
            for i in range(w):
                if kind == 3:
                    guess = (left + over[i]) // 2
                else:
                    p = left + over[i] - corner
                    pa, pb, pc = abs(p - left), abs(p - over[i]), abs(p - corner)
                    guess = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, over[i], corner))
                left, corner = (ahead[i] + guess) & 255, over[i]
                made[i] = left
            line = made.ravel()
        out[y] = line
        above = line
    values = (out.view(">u2") if depth == 16 else out).reshape(h, w, channels).astype(float)
    return values[..., 0] if channels < 3 else values[..., :3] @ np.array(GREY[::-1])


def tiff(image: np.ndarray) -> bytes:
    """An 8- or 16-bit grey image as a TIFF of one uncompressed strip, little-endian."""
    h, w = image.shape
    deep = image.dtype == np.uint16
    raw = image.astype("<u2" if deep else np.uint8).tobytes()
    # width, height, bits, compression, meaning (0 is black), strip offset, samples, rows of a strip, bytes of the strip
    tags = [(256, w), (257, h), (258, 16 if deep else 8), (259, 1), (262, 1), (273, 8), (277, 1), (278, h), (279, len(raw))]
    pad = b"\0" * (len(raw) % 2)
    entries = b"".join(struct.pack("<HHII", tag, 4, 1, value) for tag, value in tags)
    return b"II*\0" + struct.pack("<I", 8 + len(raw) + len(pad)) + raw + pad + struct.pack("<H", len(tags)) + entries + struct.pack("<I", 0)


def untiff(data: bytes) -> np.ndarray:
    """Grey values of the first image of a TIFF in strips, 8 or 16 bits, uncompressed, deflated or run-length packed; colour is weighed to grey."""
    if data[:4] not in (b"II*\0", b"MM\0*"):
        raise ValueError("not a TIFF file")
    e = "<" if data[:2] == b"II" else ">"
    at = struct.unpack_from(e + "I", data, 4)[0]
    tags: dict[int, list[int]] = {}
    for k in range(struct.unpack_from(e + "H", data, at)[0]):
        place = at + 2 + 12 * k
        tag, kind, count = struct.unpack_from(e + "HHI", data, place)
        form, size = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4)}.get(kind, ("", 0))
        if form:
            start = place + 8 if size * count <= 4 else struct.unpack_from(e + "I", data, place + 8)[0]
            tags[tag] = list(struct.unpack_from(f"{e}{count}{form}", data, start))
    w, h, depth, packing = tags[256][0], tags[257][0], tags.get(258, [1])[0], tags.get(259, [1])[0]
    channels = tags.get(277, [1])[0]
    if depth not in (8, 16) or packing not in (1, 8, 32773, 32946) or tags.get(284, [1])[0] != 1 or tags.get(317, [1])[0] != 1 or tags.get(262, [1])[0] > 2:
        raise ValueError("only TIFFs of 8 or 16 bits in strips, plain, deflated or run-length packed, are read")
    unpack = {1: lambda x: x, 8: zlib.decompress, 32946: zlib.decompress, 32773: _unpacked_runs}[packing]
    raw = b"".join(unpack(data[a : a + n]) for a, n in zip(tags[273], tags[279], strict=True))
    values = np.frombuffer(raw, e + ("u2" if depth == 16 else "u1"))[: h * w * channels].reshape(h, w, channels).astype(float)
    if tags.get(262, [1])[0] == 0:
        values = 2**depth - 1 - values
    return values[..., 0] if channels < 3 else values[..., :3] @ np.array(GREY[::-1])


def _unpacked_runs(data: bytes) -> bytes:
    out, at = [], 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out.append(data[at + 1 : at + 2 + n])
            at += 2 + n
        else:
            if n > 128:
                out.append(data[at + 1 : at + 2] * (257 - n))
            at += 2
    return b"".join(out)


def decoded(data: bytes) -> np.ndarray:
    """Grey values of a PNG or TIFF file."""
    return unpng(data) if data[:4] == b"\x89PNG" else untiff(data)


def read_frames(spark: SparkSession, path: str, start: int | None = None, stop: int | None = None, step: int = 1) -> DataFrame:
    """(frame, path, h, w, px) of the PNG and TIFF files of a path or pattern; the frame is the last number in the file's name.

    Frames are chosen by name before any file is opened.
    """
    ship(spark)
    files = spark.read.format("binaryFile").load(path).withColumn("frame", last_number(F.element_at(F.split("path", "/"), -1)))
    if start is not None:
        files = files.filter((F.col("frame") >= start) & ((F.col("frame") - start) % step == 0))
    if stop is not None:
        files = files.filter(F.col("frame") <= stop)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            images = [decoded(bytes(c)) for c in batch["content"]]
            yield pd.DataFrame({"frame": batch["frame"], "path": batch["path"], "h": [i.shape[0] for i in images], "w": [i.shape[1] for i in images], "px": [i.ravel().tolist() for i in images]})

    return files.select("frame", "path", "content").mapInPandas(run, "frame long, path string, h int, w int, px array<double>")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """The same through Spark's image source, which also reads JPEG, GIF and BMP, at 8 bits."""
    ship(spark)
    rows = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples():
                a = np.frombuffer(bytes(r.data), np.uint8).reshape(r.height, r.width, r.nChannels).astype(float)
                out.append((a[..., 0] if r.nChannels == 1 else a[..., :3] @ np.array(GREY)).ravel().tolist())
            yield pd.DataFrame({"path": batch["origin"], "h": batch["height"], "w": batch["width"], "px": out})

    made = rows.mapInPandas(run, "path string, h int, w int, px array<double>")
    return made.select(last_number(F.element_at(F.split("path", "/"), -1)).alias("frame"), "path", "h", "w", "px")


def encoded(frames: DataFrame, stretch: bool = False, kind: str = "png") -> DataFrame:
    """(frame, data): 8-bit PNG or TIFF bytes, values saturated or first stretched to 0..255."""
    ship(frames.sparkSession)
    px, write = A.stretch(F.col("px")) if stretch else F.col("px"), {"png": png, "tif": tiff}[kind]
    rows = frames.select("frame", "h", "w", F.transform(px, A.eight_bit).alias("px"))

    def run(batches):
        for batch in batches:
            made = [write(np.asarray(p, float).reshape(h, w).astype(np.uint8)) for h, w, p in zip(batch["h"], batch["w"], batch["px"], strict=True)]
            yield pd.DataFrame({"frame": batch["frame"], "data": made})

    return rows.mapInPandas(run, "frame long, data binary")


def write_frames(frames: DataFrame, folder: str, stretch: bool = False, name: str = "frame_{:06d}.png") -> int:
    """A PNG (or, by its name, TIFF) file per frame in a folder; gives the number written.

    Tasks write the files, each under another name first, so a task that is run again does no harm. A store that
    pyarrow doesn't know gets them from the driver, through Hadoop's file system and one at a time.
    """
    from pyarrow import ArrowInvalid, fs

    spark = frames.sparkSession
    rows = encoded(frames, stretch, "tif" if name.endswith((".tif", ".tiff")) else "png")
    try:
        root = fs.FileSystem.from_uri(folder if ":/" in folder else f"file://{folder}")[1]
    except ArrowInvalid:
        return _written_by_driver(spark, rows, folder, name)
    uri = folder if ":/" in folder else f"file://{folder}"

    def run(batches):
        store = fs.FileSystem.from_uri(uri)[0]
        store.create_dir(root, recursive=True)
        for batch in batches:
            for frame, data in zip(batch["frame"], batch["data"], strict=True):
                final = f"{root}/{name.format(frame)}"
                part = f"{root}/_{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(data)
                store.move(part, final)
            yield pd.DataFrame({"n": [len(batch)]})

    return int(rows.mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])


def _written_by_driver(spark: SparkSession, rows: DataFrame, folder: str, name: str) -> int:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(folder)
    store, n = root.getFileSystem(conf), 0
    for row in rows.toLocalIterator():
        out = store.create(jvm.org.apache.hadoop.fs.Path(root, name.format(row["frame"])), True)
        out.write(bytes(row["data"]))
        out.close()
        n += 1
    return n


def resampled(frames: DataFrame, w: int, h: int) -> DataFrame:
    """Images by area averaging to fit w x h, the rest at the right and below filled with the mean."""
    ship(frames.sparkSession)

    def weights(n: int, m: int) -> np.ndarray:
        edge = np.linspace(0, n, m + 1)
        i = np.arange(n)
        return np.maximum(0, np.minimum(edge[1:, None], i + 1) - np.maximum(edge[:-1, None], i)) * (m / n)

    def run(batches):
        for batch in batches:
            out = []
            for fh, fw, p in zip(batch["h"], batch["w"], batch["px"], strict=True):
                image = np.asarray(p, float).reshape(fh, fw)
                ratio = min(w / fw, h / fh)
                nh, nw = max(1, round(fh * ratio)), max(1, round(fw * ratio))
                made = np.full((h, w), image.mean())
                made[:nh, :nw] = weights(fh, nh) @ image @ weights(fw, nw).T
                out.append(made.ravel().tolist())
            yield pd.DataFrame({"frame": batch["frame"], "h": h, "w": w, "px": out})

    return frames.select("frame", "h", "w", "px").mapInPandas(run, "frame long, h int, w int, px array<double>")


def discover(paths: DataFrame) -> DataFrame:
    """(pattern, first, last, n) of sequences of numbered files: the last run of digits of a path (column path) is the number."""
    at = F.regexp_extract("path", r"^(.*?)(\d+)(?!.*\d)(.*)$", 1)
    end = F.regexp_extract("path", r"^(.*?)(\d+)(?!.*\d)(.*)$", 3)
    rows = paths.withColumn("number", last_number(F.col("path"))).filter("number is not null")
    return rows.withColumn("pattern", F.concat(at, F.lit("#"), end)).groupBy("pattern").agg(F.min("number").alias("first"), F.max("number").alias("last"), F.count(F.lit(1)).alias("n"))
