"""Sequences of image files: scanned with frames chosen before a file is opened, written file by file.

Reading goes through Spark's binary file source. A frame's number is the last run of digits of its file's name, which
Spark knows from the listing, so filters by `frame` (and the kind of file) reach the listing: other files are neither
planned nor opened, and partitions are cut by bytes (`spark.sql.files.maxPartitionBytes`). Pixels are decoded in Arrow
batches above the scan. A Python data source that takes pushed filters isn't used for reading: Spark 4.1 keeps what the
first scan pushed for each later scan of the same DataFrame, which then lack rows.

`load` says how an image arrives: `plain`, `unit` (0..1), `inverse` (rounded, then 1 - v / mean), `mean0`, `normalize`,
`divide` (v / bg - 1; 0 where the background is 0) or `subtract` ((v - bg - mean - alpha) beta + low, in 0..255).

Writing goes through a data source, a file per row. A task writes its files under a folder of its own below `_temporary`
and moves them to their places when all of them are there; the end of the job, whether good or bad, removes what is
left of it there, and a job that fails also removes what its finished tasks had moved. Names don't depend on the task, so
a task that is run again writes the same files. Any store that pyarrow knows can be written to; a path without scheme
is one of the cluster's default file system.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions import arrays as A
from ..operators import frames as fr
from ..tables import qualified, ship
from .images import decoded, png, tiff

LOADS = ("plain", "unit", "inverse", "mean0", "normalize", "divide", "subtract")


def scan_sequence(spark: SparkSession, path: str) -> DataFrame:
    """(frame, path, length, content) of the PNG and TIFF files of a path or pattern whose names hold a number."""
    files = spark.read.format("binaryFile").load(path)
    name = F.col("_metadata.file_name")
    rows = files.select(A.last_number(name).alias("frame"), "path", "length", "content").filter(name.rlike(r"(?i)\.(png|tiff?)$"))
    return rows.filter("frame is not null")


def read_sequence(spark: SparkSession, path: str, load: str = "plain", background: DataFrame | None = None, alpha: float = 0.0, beta: float = 1.0, low: float = 0.0) -> DataFrame:
    """(frame, path, h, w, px) of the images of a path or pattern; filters by `frame` decide which files are opened. `background` is a row of px, for `divide` and `subtract`."""
    if load not in LOADS:
        raise ValueError(f"load is one of {', '.join(LOADS)}, not {load}")
    if (load in ("divide", "subtract")) != (background is not None):
        raise ValueError(f"{load} takes {'a' if background is None else 'no'} background")
    ship(spark)

    @F.pandas_udf("h int, w int, px array<double>")
    def image(content: pd.Series) -> pd.DataFrame:
        made = [decoded(bytes(c)) for c in content]
        return pd.DataFrame({"h": [i.shape[0] for i in made], "w": [i.shape[1] for i in made], "px": [i.ravel() for i in made]})

    rows = scan_sequence(spark, path).select("frame", "path", image("content").alias("image")).select("frame", "path", "image.*")
    px = F.col("px")
    if load == "divide":
        return fr.divide_background(rows, background)
    if load == "subtract":
        return fr.subtract_background(rows, background, alpha, beta, low)
    made = {"plain": px, "unit": A.rescale(px, 1 / 255), "inverse": A.normalize_inverse(F.transform(px, A.rounded)), "mean0": A.normalize_mean0(px), "normalize": A.normalize(px)}
    return rows.withColumn("px", made[load])


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path with its scheme, and the path in it; names may hold any sign."""
    scheme, host, path = re.fullmatch(r"([A-Za-z][\w+.-]*):(?://([^/]*))?(/.*)", uri, re.S).groups()
    if scheme == "file":
        return fs.LocalFileSystem(), path
    store, top = fs.FileSystem.from_uri(f"{scheme}://{host or ''}/")
    return store, f"{top.rstrip('/')}{path}"


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]


class FileWriter(DataSourceWriter):
    """Rows of (name, data) as files."""

    def __init__(self, options: dict[str, str]):
        self.uri, self.job = options["path"], uuid.uuid4().hex

    def write(self, iterator: Iterator[Any]) -> Written:
        store, root = store_of(self.uri)
        own = f"{root}/_temporary/{self.job}/{uuid.uuid4().hex}"
        store.create_dir(own, recursive=True)
        names = []
        for n, row in enumerate(iterator):
            with store.open_output_stream(f"{own}/{n}") as out:
                out.write(bytes(row["data"]))
            names.append(row["name"])
        for parent in {name.rpartition("/")[0] for name in names if "/" in name}:
            store.create_dir(f"{root}/{parent}", recursive=True)
        for n, name in enumerate(names):
            store.move(f"{own}/{n}", f"{root}/{name}")
        return Written(names)

    def _clean(self) -> tuple[fs.FileSystem, str]:
        store, root = store_of(self.uri)
        for own in (f"{root}/_temporary/{self.job}", f"{root}/_temporary"):
            # other jobs may be writing into the same folder
            if store.get_file_info(own).type == fs.FileType.Directory and (own.endswith(self.job) or not store.get_file_info(fs.FileSelector(f"{root}/_temporary", allow_not_found=True))):
                store.delete_dir(own)
        return store, root

    def commit(self, messages: list[Written | None]) -> None:
        self._clean()

    def abort(self, messages: list[Written | None]) -> None:
        store, root = self._clean()
        for m in messages:
            for name in m.paths if m else []:
                if store.get_file_info(f"{root}/{name}").type == fs.FileType.File:
                    store.delete_file(f"{root}/{name}")


class NamedFiles(DataSource):
    """Rows of (name, data), written as files."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return FileWriter(dict(self.options))


def write_files(rows: DataFrame, folder: str) -> None:
    """A file per row (name string, data binary) in a folder; names may have folders of their own."""
    spark = rows.sparkSession
    ship(spark)
    spark.dataSource.register(NamedFiles)
    rows.select("name", "data").write.format("named_files").mode("append").option("path", qualified(spark, folder)).save()


def image_bytes(images: DataFrame, kind: str = "tif") -> DataFrame:
    """(name, data) of rows (name, h, w, px): 8-bit TIFF or PNG files, values rounded half to even and saturated."""
    ship(images.sparkSession)
    write = {"png": png, "tif": tiff}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(c)) for c in ("name", "h", "w", "px")]
            made = [write(np.clip(np.rint(np.asarray(p.values, float)), 0, 255).astype(np.uint8).reshape(h.as_py(), w.as_py())) for _, h, w, p in zip(*cols, strict=True)]
            yield pa.RecordBatch.from_arrays([cols[0], pa.array(made, pa.binary())], ["name", "data"])

    return images.select("name", "h", "w", "px").mapInArrow(run, "name string, data binary")


def write_sequence(frames: DataFrame, folder: str, name: str = "frame_%06d.tif", scale: tuple[float, float] | None = None) -> None:
    """A file per frame, named by its number; `scale` is the range that becomes 0..255, else values are saturated as they are."""
    px = F.col("px")
    if scale:
        lo, hi = map(float, scale)
        px = F.transform(px, lambda v: (v - lo) * 255 / (hi - lo))
    rows = frames.select(F.format_string(name, "frame").alias("name"), "h", "w", px.alias("px"))
    write_files(image_bytes(rows, "png" if name.endswith(".png") else "tif"), folder)
