"""The most correlated images of each image of a sequence, exact, with most pairs never computed.

An image less its mean, made one long, is a unit vector; the correlation of two is the product of theirs. Averages over
squares of pixels, suitably scaled, are a part of that vector; what squares of half that size add is at a right angle
to it, and so on down to pixels. So the product lies within (product of the parts) +- (sum of the products of the
lengths of what is added), for nearly `factor`^2 times fewer numbers a pair. First each image is compared, from all
pixels, with the k others that look best so; the least of these values is one that its k-th best reaches at least. Then
only pairs that may reach that of one of their two images are computed.

Sequences are cut into blocks of neighbouring images of at most `block_bytes`, by ranks that are counted in ranges of
the order. Two blocks meet by the pair of their numbers, once; a task holds two blocks of coarse images, or the images
of two blocks that take part in candidate pairs, and bounds and products of a tile of them. Candidate pairs are found,
computed and dropped there; what is written is a row per image and pair of blocks, whatever the number of pairs.
A sequence with a third of all images is spread over its pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.toplist import Best, best_of_blocks, cuts, exact
from ..tables import materialize, ship
from .frames import BLOCK_BYTES, block_size, entropy, matrix, most_correlated, pairs_of_blocks, smoothed

#: Room for rounding errors of bounds.
SLACK = 1e-9


def ranked(rows: DataFrame, by: str, order: str) -> DataFrame:
    """`rows` with `rank` (from 0) and `total` within `by`, in `order`, nulls last. Ranks are counted in ranges of the order, so no task holds a whole group; `rows` is written once."""
    spark, last = rows.sparkSession, F.col(order).asc_nulls_last()
    ranged = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), by, last).withColumn("__part", F.spark_partition_id())
    ranged = materialize(ranged, "ranked")
    own = ranged.withColumn("__at", F.row_number().over(Window.partitionBy(by, "__part").orderBy(last)) - 1)
    sizes = ranged.groupBy(by, "__part").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(by).orderBy("__part")  # a row per partition
    sizes = sizes.withColumns({"__before": F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "total": F.sum("__n").over(Window.partitionBy(by))})
    named = sizes.select(F.col(by).alias("__by"), F.col("__part").alias("__p"), "__before", "total")
    joined = own.join(named, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__part") == F.col("__p")))
    return joined.withColumn("rank", F.col("__before") + F.col("__at")).drop("__part", "__at", "__by", "__p", "__before")


def coarse_parts(images: np.ndarray, factor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of images (n, h, w): deviations from their means, their lengths, coarse parts of the unit vectors, and the lengths of what each halving of `factor` (a power of two) adds."""
    n, h, w = images.shape
    dev = images - images.mean((1, 2), keepdims=True)
    size = np.sqrt((dev * dev).sum((1, 2)))
    unit = dev / np.where(size > 0, size, 1)[:, None, None]

    def averaged(f: int) -> np.ndarray:
        rows, cols = np.arange(0, h, f), np.arange(0, w, f)
        sums = np.add.reduceat(np.add.reduceat(unit, rows, axis=1), cols, axis=2)
        return (sums / np.sqrt(np.outer(np.diff(np.append(rows, h)), np.diff(np.append(cols, w))))).reshape(n, -1)

    part, power, f = averaged(factor), [], factor
    power.append((part * part).sum(1))
    while f > 1:
        f //= 2
        power.append((averaged(f) ** 2).sum(1))
    rests = np.sqrt(np.maximum(np.diff(np.array(power), axis=0), 0)).T
    return dev.reshape(n, -1), size, part, rests


@dataclass
class Found:
    """`best` as `most_correlated` gives it, and (by, pairs, computed): how many pairs there are and how many were computed."""

    best: DataFrame
    report: DataFrame


@dataclass
class Side:
    """Coarse images of a block, as arrays."""

    frame: np.ndarray
    size: np.ndarray
    part: np.ndarray
    rests: np.ndarray
    least: np.ndarray | None = None
    dev: np.ndarray | None = None

    @classmethod
    def of(cls, rows: pa.Table) -> Side:
        named = {c: matrix(rows[c]) if c in ("part", "rests", "dev") else rows[c].to_numpy() for c in ("frame", "size", "part", "rests", "least", "dev") if c in rows.column_names}
        return cls(**named)


def _sides(key, rows: pa.Table) -> tuple[Side | None, Side | None]:
    """The two blocks that meet, the second none where it is the first."""
    i, j, at = key[1].as_py(), key[2].as_py(), rows["block"].to_numpy()
    take = lambda k: Side.of(rows.filter(pa.array(at == k))) if (at == k).any() else None
    return take(i), None if i == j else take(j)


def _bounds(a: Side, b: Side, r, c) -> np.ndarray:
    """The most that correlations of some images of two blocks may be."""
    both = np.multiply.outer(a.size[r], b.size[c])
    both /= both + 1e-8
    both *= a.part[r] @ b.part[c].T + a.rests[r] @ b.rests[c].T
    return both


def _wanted(a: Side, b: Side, r, c, slack: float) -> np.ndarray:
    """Which pairs may reach what the best of one of their images reach."""
    high = _bounds(a, b, r, c)
    return (high >= a.least[r][:, None] - slack) | (high >= b.least[c][None, :] - slack)


def _table(by: str, key, rows: pa.Table, **columns) -> pa.Table:
    n = len(next(iter(columns.values())))
    return pa.table({by: pa.array([key[0].as_py()] * n, rows.schema.field(by).type), **columns})


def _computed(some: DataFrame, parts: DataFrame, by: str, kind: str, most: int, digits: int) -> DataFrame:
    """(by, frame, other, corr), both ways, of listed pairs (by, i, j, one, two), of each list the `most` best of an image; a task has the images that its list names."""
    needed = some.select(F.col(by).alias("__by"), "i", "j", F.explode(F.array("one", "two")).alias("__f")).distinct()
    sent = needed.join(parts.select(by, "frame", "dev"), F.col(by).eqNullSafe(F.col("__by")) & (F.col("frame") == F.col("__f"))).select(F.col(by).alias("__s"), F.col("i").alias("__i"), F.col("j").alias("__j"), "frame", "dev")

    def run(key, pairs, images):
        at, dev = images["frame"].to_numpy(), matrix(images["dev"])
        order = np.argsort(at, kind="stable")
        at, dev = at[order], dev[order]
        power = (dev * dev).sum(1)
        one, two = (np.searchsorted(at, pairs[c].to_numpy()) for c in ("one", "two"))
        corr, best = exact(dev, dev, one, two, power, power, digits), Best(len(at), most)
        best.add(np.concatenate([one, two]), at[np.concatenate([two, one])], np.concatenate([corr, corr]))
        frame, other, corr = best.found(at)
        return _table(by, key, pairs, frame=frame, other=other, corr=corr)

    return some.groupBy(by, "i", "j").cogroup(sent.groupBy("__s", "__i", "__j")).applyInArrow(run, f"{by} {kind}, frame long, other long, corr double")


def best_correlated_bounded(frames: DataFrame, by: str, most: int, factor: int = 4, block_bytes: int = BLOCK_BYTES, digits: int = 15) -> Found:
    """What `best_correlated` gives: the `most` other images of each image (by, frame, h, w, px), highest correlation first.

    Images of a sequence have one size and frames of it differ. A sequence of one image gives no rows.
    """
    ship(frames.sparkSession)
    kind = frames.schema[by].dataType.simpleString()
    pixels = frames.agg(F.max(F.size("px"))).first()[0]
    if pixels is None:
        empty = frames.sparkSession.createDataFrame([], f"{by} {kind}, frame long, other long, corr double, rank int")
        return Found(empty, empty.select(by, F.lit(0).cast("long").alias("pairs"), F.lit(0).cast("long").alias("computed")))
    per = block_size(pixels, block_bytes)
    rows = ranked(frames.select(by, F.col("frame").cast("long").alias("frame"), "h", "w", "px"), by, "frame")
    blocks = F.ceil(F.col("total") / per)
    rows = rows.withColumns({"block": F.floor(F.col("rank") * blocks / F.col("total")).cast("long"), "blocks": blocks.cast("long")})

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (_, _), some in batch.groupby(["h", "w"]):
                h, w = int(some["h"].iloc[0]), int(some["w"].iloc[0])
                dev, size, part, rests = coarse_parts(np.stack(some["px"].to_list()).astype(float).reshape(-1, h, w), factor)
                yield some[[by, "frame", "block", "blocks"]].assign(dev=list(dev), size=size, part=list(part), rests=list(rests))

    parts = materialize(rows.select(by, "frame", "h", "w", "px", "block", "blocks").mapInPandas(split, f"{by} {kind}, frame long, block long, blocks long, dev array<double>, size double, part array<double>, rests array<double>"), "correlated")
    coarse = parts.select(by, "frame", "block", "blocks", "size", "part", "rests")

    def promising(key, rows):
        a, b = _sides(key, rows)
        made = []
        for own, other in ((a, a),) if key[1] == key[2] else ((a, b), (b, a)):
            for r in cuts(len(own.frame), 256):
                high = _bounds(own, other, r, slice(None))
                if own is other:
                    high[np.arange(r.stop - r.start), np.arange(r.start, r.stop)] = -np.inf
                top = np.argpartition(-high, min(most, high.shape[1]) - 1, axis=1)[:, :most]
                f, g = np.repeat(own.frame[r], top.shape[1]), other.frame[top.ravel()]
                made.append((f, *((f, g) if own is a else (g, f)), np.take_along_axis(high, top, 1).ravel()))
        frame, one, two, high = (np.concatenate(x) for x in zip(*made, strict=True))
        return _table(by, key, rows, i=np.full(len(frame), key[1].as_py()), j=np.full(len(frame), key[2].as_py()), frame=frame, one=one, two=two, high=high)

    looks = pairs_of_blocks(coarse).groupBy(by, "i", "j").applyInArrow(promising, f"{by} {kind}, i long, j long, frame long, one long, two long, high double").filter("one <> two")
    best_looks = looks.withColumn("nth", F.row_number().over(Window.partitionBy(by, "frame").orderBy(F.desc("high"), "one", "two"))).filter(F.col("nth") <= most)
    listed = best_looks.select(by, "i", "j", F.least("one", "two").alias("lo"), F.greatest("one", "two").alias("hi"), "one", "two").dropDuplicates([by, "lo", "hi"])
    first = materialize(listed.select(by, "i", "j", "one", "two"), "correlated-first")
    known = _computed(first, parts, by, kind, most, digits)
    nth = F.row_number().over(Window.partitionBy(by, "frame").orderBy(F.desc("corr")))
    least = materialize(known.withColumn("nth", nth).filter(F.col("nth") == most).select(F.col(by).alias("__by"), F.col("frame").alias("__f"), "corr"), "correlated-least")
    marked = parts.join(least, F.col(by).eqNullSafe(F.col("__by")) & (F.col("frame") == F.col("__f")), "left").withColumn("least", F.coalesce("corr", F.lit(-2.0)))
    slack = SLACK + 2 * 10.0**-digits
    marked = materialize(marked.select(by, "frame", "block", "blocks", "size", "part", "rests", "least"), "correlated-marked")

    def candidates(key, rows):
        a, b = _sides(key, rows)
        same = b is None
        b = a if same else b
        in_a, in_b = np.zeros(len(a.frame), bool), np.zeros(len(b.frame), bool)
        for r in cuts(len(a.frame)):
            for c in cuts(len(b.frame)):
                want = _wanted(a, b, r, c, slack)
                if same and r == c:
                    np.fill_diagonal(want, False)
                in_a[r] |= want.any(1)
                in_b[c] |= want.any(0)
        frame = a.frame[in_a | in_b] if same else np.concatenate([a.frame[in_a], b.frame[in_b]])
        return _table(by, key, rows, i=np.full(len(frame), key[1].as_py()), j=np.full(len(frame), key[2].as_py()), frame=frame)

    named = pairs_of_blocks(marked).groupBy(by, "i", "j").applyInArrow(candidates, f"{by} {kind}, i long, j long, frame long")
    named = materialize(named.select(F.col(by).alias("__by"), "i", "j", F.col("frame").alias("__f")), "correlated-named")
    whole = marked.join(parts.select(F.col(by).alias("__b"), F.col("frame").alias("__d"), "dev"), F.col(by).eqNullSafe(F.col("__b")) & (F.col("frame") == F.col("__d"))).drop("__b", "__d")
    sent = named.join(whole, F.col(by).eqNullSafe(F.col("__by")) & (F.col("frame") == F.col("__f"))).select(by, "i", "j", "frame", "block", "size", "part", "rests", "least", "dev")

    def best_of(key, rows):
        a, b = _sides(key, rows)
        other = b or a
        (frame, to, corr), n = best_of_blocks((a.frame, a.dev), b and (b.frame, b.dev), most, digits, lambda r, c: _wanted(a, other, r, c, slack), (a.least, other.least))
        # the row without a frame says how many pairs were computed
        return _table(by, key, rows, frame=pa.array([None, *frame.tolist()], pa.int64()), other=np.append(n, to), corr=np.append(0.0, corr))

    made = materialize(sent.groupBy(by, "i", "j").applyInArrow(best_of, f"{by} {kind}, frame long, other long, corr double"), "correlated-best")
    total = rows.groupBy(by).agg((F.count(F.lit(1)) * (F.count(F.lit(1)) - 1) / 2).cast("long").alias("pairs"))
    counted = first.groupBy(by).agg(F.count(F.lit(1)).alias("n")).unionByName(made.filter("frame is null").select(by, F.col("other").alias("n")))
    computed = counted.groupBy(F.col(by).alias("__by")).agg(F.sum("n").cast("long").alias("computed"))
    report = total.join(computed, F.col(by).eqNullSafe(F.col("__by")), "left").select(by, "pairs", F.coalesce("computed", F.lit(0).cast("long")).alias("computed"))
    made = made.filter("frame is not null")
    return Found(most_correlated(made, by, most), report)


def area_weights(n: int, m: int) -> np.ndarray:
    """Shares of n pixels in each of m equal parts of their line."""
    edge, i = np.linspace(0, n, m + 1), np.arange(n)
    return np.maximum(0, np.minimum(edge[1:, None], i + 1) - np.maximum(edge[:-1, None], i)) * (m / n)


def resized(frames: DataFrame, by: str, share: float) -> DataFrame:
    """(by, frame, h, w, px): images of `share` of the height and width, by area averages; 1 or more leaves them as they are."""
    rows = frames.select(by, "frame", "h", "w", "px")
    if share >= 1:
        return rows
    ship(frames.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for h, w, p in zip(batch["h"], batch["w"], batch["px"], strict=True):
                image = np.asarray(p, float).reshape(h, w)
                made.append(area_weights(h, max(1, round(h * share))) @ image @ area_weights(w, max(1, round(w * share))).T)
            yield batch[[by, "frame"]].assign(h=[i.shape[0] for i in made], w=[i.shape[1] for i in made], px=[i.ravel() for i in made])

    kind, number = (frames.schema[c].dataType.simpleString() for c in (by, "frame"))
    return rows.mapInPandas(run, f"{by} {kind}, frame {number}, h int, w int, px array<double>")


def images_to_use(entropies: np.ndarray, least: int) -> int:
    """Of running means over 1, 2, ... images, how many to take: up to the first fall of the smoothed entropies (differences below 1e-9 are none), the second without a fall, `least` at least, all at most."""
    fall = np.flatnonzero(np.diff(smoothed(entropies)) < -1e-9)
    at = int(fall[0]) + 1 if len(fall) else 1
    return max(least - 1, min(at, len(entropies) - 1)) + 1


def correlation_background(frames: DataFrame, by: str, least: int, most: int, share: float = 0.25, digits: int = 15, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(by, frame, used, px): of each image the mean of the images that are correlated with it most.

    Correlations, and the entropies (of an image less the running mean of 1, 2, ... up to `most` others) that say how many
    are used, are of images resized by `share`; the mean is of whole images, of which a task has `most` at once.
    """
    ship(frames.sparkSession)
    small = materialize(resized(frames, by, share), "background-small")
    best = materialize(best_correlated_bounded(small, by, most, block_bytes=block_bytes, digits=digits).best, "background-best")
    same = lambda a, b: F.col(by).eqNullSafe(F.col(a)) & (F.col(b[0]) == F.col(b[1]))
    other = lambda df, px: df.select(F.col(by).alias("__by"), F.col("frame").cast("long").alias("__other"), F.col("px").alias(px))
    near = best.join(other(small, "p"), same("__by", ("other", "__other"))).groupBy(by, "frame").agg(F.array_sort(F.collect_list(F.struct("rank", "p"))).alias("stack"))
    both = near.join(other(small, "own"), same("__by", ("frame", "__other")))

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            used = []
            for stack, own in zip(batch["stack"], batch["own"], strict=True):
                images = np.array([s["p"] for s in stack], float)
                mean = np.cumsum(images, 0) / np.arange(1, len(images) + 1)[:, None]
                rest = np.asarray(own, float) - mean
                used.append(images_to_use(np.array([entropy(np.floor(np.maximum(r, 0) + 0.5)) for r in rest]), least))
            yield batch[[by, "frame"]].assign(used=used)

    kind = frames.schema[by].dataType.simpleString()
    used = materialize(both.select(by, "frame", "stack", "own").mapInPandas(choose, f"{by} {kind}, frame long, used int"), "background-used")
    named = used.select(F.col(by).alias("__u"), F.col("frame").alias("__f"), F.least("used", F.lit(most)).alias("used"))
    taken = best.join(named, F.col(by).eqNullSafe(F.col("__u")) & (F.col("frame") == F.col("__f"))).filter("rank <= used")
    stacks = taken.join(other(frames, "p"), same("__by", ("other", "__other"))).groupBy(by, "frame").agg(F.count(F.lit(1)).cast("int").alias("used"), F.array_sort(F.collect_list(F.struct("rank", "p"))).alias("stack"))
    total = F.aggregate(F.slice("stack", 2, most), F.get("stack", F.lit(0))["p"], lambda acc, s: F.zip_with(acc, s["p"], lambda a, b: a + b))
    return stacks.select(by, "frame", "used", F.transform(total, lambda v: v / F.col("used")).alias("px"))
