"""Transforms, propagation and inversion of images: one image is one row, computed in Arrow batches, nothing shuffled."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Optics, Solver
from ..functions import optics as O
from ..functions import solvers
from ..tables import ship

#: Values that are held before rows are sent on.
HELD = 2**16
PLANE = "frame long, z_idx int, z double, h int, w int, re array<double>, im array<double>"


def _map(frames: DataFrame, one: Callable[[int, np.ndarray], Iterator[tuple]], schema: str, spread: bool = False) -> DataFrame:
    """Rows that `one` makes of (frame, image). `spread` deals images over all tasks first, where computing takes far longer than moving them."""
    spark = frames.sparkSession
    ship(spark)
    if spread:
        frames = frames.select("frame", "h", "w", "px").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "frame")
    names = [c.split()[0] for c in schema.split(", ")]

    wide = "array" in schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # rows of many small images are sent together
        rows, held = [], 0
        for batch in batches:
            for frame, h, w, px in zip(batch["frame"], batch["h"], batch["w"], batch["px"], strict=True):
                made = list(one(int(frame), np.asarray(px, float).reshape(h, w)))
                rows += made
                held += len(made) * (int(h) * int(w) if wide else 1)
                if held >= HELD:
                    yield pd.DataFrame(rows, columns=names)
                    rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=names)

    return frames.select("frame", "h", "w", "px").mapInPandas(run, schema)


def _values(column: pa.Array) -> np.ndarray:
    """The values of arrays, one after the other; nulls among them are NaN."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float)


def _together(batch: pa.RecordBatch, planes: int = 1) -> Iterator[slice]:
    """Rows of images of one size (h, w), as many as `HELD` values in all their planes, one at least."""
    h, w = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h", "w"))
    edges = [0, *(np.flatnonzero((np.diff(h) != 0) | (np.diff(w) != 0)) + 1).tolist(), len(h)]
    for a, b in zip(edges, edges[1:], strict=False):
        step = max(1, HELD // max(1, planes * int(h[a]) * int(w[a]))) if b > a else 1
        yield from (slice(k, min(k + step, b)) for k in range(a, b, step))


def _stack(batch: pa.RecordBatch, rows: slice, *columns: str) -> list[np.ndarray]:
    """Images (n, h, w) of rows of one size."""
    part = batch.slice(rows.start, rows.stop - rows.start)
    h, w = (part.column(c)[0].as_py() for c in ("h", "w"))
    return [_values(part.column(c)).reshape(part.num_rows, h, w) for c in columns]


def _lists(images: np.ndarray) -> pa.Array:
    """An array of values per image (n, h, w)."""
    n, size = len(images), images[0].size
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * size), pa.array(np.ascontiguousarray(images).ravel()))


def _ints(n: int, value: int) -> pa.Array:
    return pa.array(np.full(n, value, np.int32))


def _plane(frame: int, i: int, z: float, field: np.ndarray) -> tuple:
    h, w = field.shape
    return frame, i, float(z), h, w, field.real.ravel().tolist(), np.imag(field).ravel().tolist()


def spectrum(frames: DataFrame, shifted: bool = False) -> DataFrame:
    def one(frame, image):
        f = np.fft.fft2(image)
        yield _plane(frame, 0, 0.0, np.fft.fftshift(f) if shifted else f)

    return _map(frames, one, PLANE)


def inverse_spectrum(planes: DataFrame, shifted: bool = False) -> DataFrame:
    """Planes of spectra back to fields."""
    ship(planes.sparkSession)

    def run(batches):
        for batch in batches:
            re, im = [], []
            for h, w, a, b in zip(batch["h"], batch["w"], batch["re"], batch["im"], strict=True):
                f = (np.asarray(a) + 1j * np.asarray(b)).reshape(h, w)
                x = np.fft.ifft2(np.fft.ifftshift(f) if shifted else f)
                re.append(x.real.ravel().tolist())
                im.append(x.imag.ravel().tolist())
            yield batch.assign(re=re, im=im)

    return planes.mapInPandas(run, planes.schema)


def propagated(frames: DataFrame, optics: Optics, kind: str = "rs_phase", power: bool = False) -> DataFrame:
    """Every image at every depth (planes); of power, re is the squared magnitude."""
    ship(frames.sparkSession)
    depths = [float(z) for z in optics.depths()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # images of one size are transformed together, and a depth is taken at a time where images are large
        for batch in batches:
            for rows in _together(batch):
                (images,) = _stack(batch, rows, "px")
                n, h, w = images.shape
                ids, f = batch.column("frame").slice(rows.start, n).to_numpy(zero_copy_only=False), np.fft.fft2(images)
                step = max(1, HELD // images.size)
                for k in range(0, len(depths), step):
                    some = depths[k : k + step]
                    t = np.stack([O.transfer(kind, h, w, z, optics.wavelength, optics.resolution) for z in some])
                    x = np.fft.ifft2(f[:, None] * t).reshape(-1, h, w)
                    re, im = (np.abs(x) ** 2, np.zeros(x.shape)) if power else (x.real, x.imag)
                    at = np.tile(np.arange(k, k + len(some), dtype=np.int32), n)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(ids, len(some)), pa.int64()), pa.array(at), pa.array(np.tile(some, n)), _ints(len(x), h), _ints(len(x), w), _lists(re), _lists(im)],
                        ["frame", "z_idx", "z", "h", "w", "re", "im"],
                    )

    return frames.select("frame", "h", "w", "px").mapInArrow(run, PLANE)


def projected(frames: DataFrame, optics: Optics, how: str = "max", kind: str = "rs_phase") -> DataFrame:
    """(frame, y, x, v, z_idx): the greatest (least) power over depths and its plane, the later on a tie, kept plane by plane so no volume is held."""
    depths, sign = optics.depths(), 1 if how == "max" else -1

    def one(frame, image):
        f = np.fft.fft2(image)
        best, at = np.full(image.shape, -np.inf), np.zeros(image.shape, int)
        for i, z in enumerate(depths):
            p = sign * np.abs(np.fft.ifft2(f * O.transfer(kind, *image.shape, z, optics.wavelength, optics.resolution))) ** 2
            at = np.where(p >= best, i, at)
            best = np.maximum(best, p)
        for y, x in np.ndindex(*image.shape):
            yield frame, y, x, float(sign * best[y, x]), int(at[y, x])

    return _map(frames, one, "frame long, y int, x int, v double, z_idx int")


def back_projected(planes: DataFrame, optics: Optics) -> DataFrame:
    """(frame, h, w, px): the real image of a frame's planes. Spectra are summed per frame before the one inverse transform: first of
    the planes that follow each other in a task, so that what is shuffled is mostly one spectrum of a frame."""
    ship(planes.sparkSession)
    wave, res = optics.wavelength, optics.resolution

    def spectra(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _sums(batches, lambda field, z: np.fft.fft2(field) * _by_depth(z, *field.shape[1:]), ["frame", "z", "h", "w", "re", "im"])

    def images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sums(batches, lambda field, z: field, ["frame", "z", "h", "w", "re", "im"]):
            for rows in _together(batch):
                re, im = _stack(batch, rows, "re", "im")
                made = [batch.column(c).slice(rows.start, len(re)) for c in ("frame", "h", "w")]
                yield pa.RecordBatch.from_arrays([*made, _lists(np.fft.ifft2(re + 1j * im).real)], ["frame", "h", "w", "px"])

    def _by_depth(z: np.ndarray, h: int, w: int) -> np.ndarray:
        kinds, at = np.unique(z, return_inverse=True)
        t = [O.transfer("rs_phase", h, w, -k, wave, res) for k in kinds.tolist()]
        return t[0] if len(t) == 1 else np.stack(t)[at]

    parts = planes.filter("frame is not null").select("frame", "z", "h", "w", "re", "im").mapInArrow(spectra, "frame long, z double, h int, w int, re array<double>, im array<double>")
    by_frame = parts.repartition(int(planes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "frame").sortWithinPartitions("frame", "z")
    return by_frame.mapInArrow(images, "frame long, h int, w int, px array<double>")


def _sums(batches: Iterator[pa.RecordBatch], made: Callable[[np.ndarray, np.ndarray], np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows (frame, z, h, w, re, im), each the sum of what `made` makes of fields and their depths, over rows of one frame that follow each other; z is that of the first."""

    def batch_of(ids, z, total):
        n, (h, w) = len(total), total.shape[1:]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(z, pa.float64()), _ints(n, h), _ints(n, w), _lists(total.real), _lists(total.imag)], names)

    # the sum of a frame may go on in the next rows
    open_: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
    for batch in batches:
        for rows in _together(batch):
            re, im = _stack(batch, rows, "re", "im")
            ids, z = (batch.column(c).slice(rows.start, len(re)).to_numpy(zero_copy_only=False) for c in ("frame", "z"))
            parts = made(re + 1j * im, z)
            if open_ is not None:
                if open_[0][0] == ids[0]:
                    if open_[2].shape[1:] != parts.shape[1:]:
                        raise ValueError(f"planes of different sizes in frame {ids[0]}")
                    ids, z, parts = (np.concatenate(p) for p in zip(open_, (ids, z, parts), strict=True))
                else:
                    yield batch_of(*open_)
            # row by row of each frame, so that sums don't depend on where rows are cut
            first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            count = np.diff(np.append(first, len(ids)))
            total = parts[first]
            for k in range(1, int(count.max())):
                more = np.flatnonzero(count > k)
                total[more] += parts[first[more] + k]
            if len(first) > 1:
                yield batch_of(ids[first[:-1]], z[first[:-1]], total[:-1])
            open_ = ids[first[-1:]], z[first[-1:]], total[-1:]
    if open_ is not None:
        yield batch_of(*open_)


def focus(frames: DataFrame, optics: Optics, taper: float = 0.1, a: float = 2.5) -> DataFrame:
    """(frame, z_idx, raw_real, raw_imag)."""
    depths = optics.depths()

    def one(frame, image):
        for i, (re, im) in enumerate(O.focus_sums(image, depths, optics.wavelength, optics.resolution, taper, a)):
            yield frame, i, float(re), float(im)

    return _map(frames, one, "frame long, z_idx int, raw_real double, raw_imag double")


def deconvolved(frames: DataFrame, optics: Optics, beta: float = 1.0) -> DataFrame:
    def one(frame, image):
        depths = optics.depths()
        for i, p in enumerate(O.deconvolve(image, depths, optics.wavelength, optics.resolution, beta)):
            yield _plane(frame, i, depths[i], p)

    return _map(frames, one, PLANE, spread=True)


def without_objects(frames: DataFrame, objects: DataFrame, optics: Optics) -> DataFrame:
    """Images with objects (frame, label, z_idx, cells = array of y * w + x) filled by their surroundings, one after the other by label."""
    ship(frames.sparkSession)
    depths = optics.depths()
    lists = objects.groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("label", "z_idx", "cells"))).alias("objects"))

    def run(batches):
        for batch in batches:
            out = []
            for h, w, px, found in zip(batch["h"], batch["w"], batch["px"], batch["objects"], strict=True):
                image = np.asarray(px, float).reshape(h, w)
                for o in found if found is not None else []:
                    mask = np.zeros(h * w, bool)
                    mask[np.asarray(o["cells"], int)] = True
                    image = O.remove_object(image, mask.reshape(h, w), depths[o["z_idx"]], optics.wavelength, optics.resolution)
                out.append(image.ravel().tolist())
            yield batch.assign(px=out)[["frame", "h", "w", "px"]]

    return frames.select("frame", "h", "w", "px").join(lists, "frame", "left").mapInPandas(run, "frame long, h int, w int, px array<double>")


def refined(frames: DataFrame, points: DataFrame, optics: Optics, step: float = 1.0, extent: int = 8) -> DataFrame:
    """Points (frame, part, x, y, z) moved to where their rings fit the image best, with the residual."""
    spark = frames.sparkSession
    ship(spark)

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                best, low = O.shake(np.asarray(r.px, float).reshape(r.h, r.w), np.array([r.x, r.y, r.z]), step, optics.wavelength, optics.resolution, extent, turns=3, points=11)
                rows.append((r.frame, r.part, *best.tolist(), low))
            yield pd.DataFrame(rows, columns=["frame", "part", "x", "y", "z", "residual"])

    # points are dealt over all tasks, as computing takes far longer than moving them
    dealt = points.join(frames.select("frame", "h", "w", "px"), "frame").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "frame", "part")
    return dealt.mapInPandas(run, "frame long, part long, x double, y double, z double, residual double")


def _problem(image: np.ndarray, optics: Optics, s: Solver, how: str) -> solvers.Problem:
    return solvers.Problem(image, optics.depths(), optics.wavelength, optics.resolution, s.l1, s.tv, how, s.inner)


def inverted(frames: DataFrame, optics: Optics, solver: Solver, how: str = "fused2d", method: str = "fasta") -> DataFrame:
    """Voxels (frame, z, y, x, re, im) of the regularised inverse of every image."""
    schema = "frame long, z int, y int, x int, re double, im double"
    if method in solvers.TOGETHER:
        spark, planes = frames.sparkSession, len(optics.depths())
        ship(spark)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for rows in _together(batch, planes):
                    (images,) = _stack(batch, rows, "px")
                    x = solvers.TOGETHER[method](_problem(images, optics, solver, how), solver.outer)
                    at = np.nonzero(x)
                    v, ids = x[at], batch.column("frame").slice(rows.start, len(images)).to_numpy(zero_copy_only=False)
                    cells = [pa.array(ids[at[0]], pa.int64()), *(pa.array(k.astype(np.int32)) for k in at[1:])]
                    yield pa.RecordBatch.from_arrays([*cells, pa.array(np.ascontiguousarray(v.real)), pa.array(np.ascontiguousarray(v.imag))], ["frame", "z", "y", "x", "re", "im"])

        dealt = frames.select("frame", "h", "w", "px").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "frame")
        return dealt.mapInArrow(run, schema)

    def one(frame, image):
        x, _ = solvers.SOLVERS[method](_problem(image, optics, solver, how), solver.outer)
        at = np.nonzero(x)
        v = x[at]
        yield from zip([frame] * len(v), *(k.tolist() for k in at), v.real.tolist(), v.imag.tolist(), strict=True)

    return _map(frames, one, schema, spread=True)


def solver_metrics(frames: DataFrame, optics: Optics, solver: Solver, how: str = "fused2d", method: str = "fasta") -> DataFrame:
    """(frame, it, f, sparsity, stepsize, total_backtracks)."""

    def one(frame, image):
        _, t = solvers.SOLVERS[method](_problem(image, optics, solver, how), solver.outer)
        for i, row in enumerate(zip(t.objective, t.sparsity, t.step, np.cumsum(t.backtracks).tolist(), strict=True)):
            yield frame, i, *row

    return _map(frames, one, "frame long, it int, f double, sparsity double, stepsize double, total_backtracks int", spread=True)
