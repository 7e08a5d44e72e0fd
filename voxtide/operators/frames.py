"""Backgrounds of image sequences and what is made with them.

Images are rows of `frames` (frame, h, w, px). What concerns one image is an array expression and isn't shuffled. What
goes over images is grouped by pixel: partial sums are combined before the shuffle, so at most one row per pixel and
task moves. A background is one array, bounded by the size of an image, and is broadcast as a single row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import arrays as A
from ..functions.toplist import best_of_blocks
from ..tables import ship


def pixels(frames: DataFrame, *keep: str) -> DataFrame:
    """(keep, frame, y, x, v): long form."""
    rows = frames.select(*keep, "frame", "w", F.posexplode("px").alias("pos", "v"))
    return rows.select(*keep, "frame", F.expr("pos div w").cast("int").alias("y"), (F.col("pos") % F.col("w")).alias("x"), "v")


def selected(frames: DataFrame, start: int, stop: int, step: int = 1) -> DataFrame:
    """Frames start..stop, each `step`-th."""
    return frames.filter(F.col("frame").between(start, stop) & ((F.col("frame") - start) % step == 0))


def mean_frames(start: int, stop: int) -> tuple[int, int, int]:
    """First, last and step of the frames that a background over start..stop averages: stop - start - 1 of them, thinned above 500."""
    count = stop - start - 1
    return start, start + count - 1, count // 200 if count > 500 else 1


def as_image(per_pixel: DataFrame, value: str, w: int) -> DataFrame:
    """One row (px) of (y, x, value)."""
    cell = F.struct((F.col("y") * w + F.col("x")).alias("pos"), F.col(value).alias("v"))
    return per_pixel.agg(F.transform(F.array_sort(F.collect_list(cell)), lambda c: c["v"]).alias("px"))


def mean_background(frames: DataFrame, *by: str) -> DataFrame:
    """(by, y, x, bg): pixel means, for each value of `by`."""
    return pixels(frames, *by).groupBy(*by, "y", "x").agg(F.avg("v").alias("bg"))


def background_stats(frames: DataFrame, background: DataFrame, spread: float = 5.0) -> DataFrame:
    """One row: alpha = mean of means - spread * mean of deviations, beta = 255 / (2 spread mean of deviations), both of frame - background, and the least and mean background."""
    rest = frames.crossJoin(F.broadcast(background.withColumnRenamed("px", "bg"))).withColumn("rest", F.zip_with("px", "bg", lambda a, b: a - b))
    per = rest.select(A.array_mean(F.col("rest")).alias("m"), A.array_std(F.col("rest")).alias("s"), "bg")
    bg = F.first("bg")
    return per.agg((F.avg("m") - spread * F.avg("s")).alias("alpha"), (255 / (2 * spread * F.avg("s"))).alias("beta"), F.array_min(bg).alias("minimum"), A.array_mean(bg).alias("average"))


def median5_background(frames: DataFrame, *by: str) -> DataFrame:
    """(by, frame, y, x, bg) for the i-th of N frames, i = 0..N-3: the median of five.

    From the eighth on these are the frame and the four before it. The first three outputs are of the first five
    frames, and frames 3 to 6 replace the first four of these one after the other.
    """
    w = Window.partitionBy(*by, "y", "x")
    o = w.orderBy("frame")
    px = pixels(frames, *by).withColumns({"i": F.row_number().over(o) - 1, "n": F.count(F.lit(1)).over(w)})
    px = px.withColumns({f"p{k}": F.lag("v", k).over(o) for k in range(1, 5)})
    px = px.withColumns({f"f{k}": F.max(F.when(F.col("i") == k, F.col("v"))).over(w) for k in range(7)})
    f = [F.col(f"f{k}") for k in range(7)]
    five = (
        F.when(F.col("i") <= 2, F.array(*f[:5]))
        .when(F.col("i") == 3, F.array(f[3], f[1], f[2], f[3], f[4]))
        .when(F.col("i") == 4, F.array(f[3], f[4], f[2], f[3], f[4]))
        .when(F.col("i") == 5, F.array(f[3], f[4], f[5], f[3], f[4]))
        .when(F.col("i") == 6, F.array(f[3], f[4], f[5], f[6], f[4]))
        .otherwise(F.array("v", "p1", "p2", "p3", "p4"))
    )
    return px.filter("n >= 5 and i <= n - 3").select(*by, "frame", "y", "x", F.get(F.array_sort(five), F.lit(2)).alias("bg"))


def moving_background(frames: DataFrame, width: int, *by: str) -> DataFrame:
    """(by, frame, y, x, bg): the mean of width - 2 frames from width // 2 before a frame on, the window shifted inwards at both ends. Frames are numbered without gaps."""
    if width < 3:
        raise ValueError("a moving background takes three frames or more")
    w = Window.partitionBy(*by, "y", "x")
    o = w.orderBy("frame")
    half = width // 2
    px = pixels(frames, *by).withColumns({"first": F.min("frame").over(w), "last": F.max("frame").over(w)})
    px = px.withColumn("m", F.avg("v").over(o.rowsBetween(-half, -half + width - 3)))
    start = F.greatest(F.col("first"), F.least(F.col("frame") - half, F.col("last") - width + 1))
    lo, hi = F.col("first") + half, F.col("last") - width + 1 + half
    at = F.when(F.col("frame") < lo, F.max(F.when(F.col("frame") == lo, F.col("m"))).over(w))
    at = at.when(F.col("frame") > hi, F.max(F.when(F.col("frame") == hi, F.col("m"))).over(w)).otherwise(F.col("m"))
    return px.withColumn("start", start).select(*by, "frame", "y", "x", "start", at.alias("bg"))


def correlations(frames: DataFrame, by: str) -> DataFrame:
    """(by, frame, other, corr) of all pairs of different frames of a sequence: sum(da db) / (sqrt(sum(da^2) sum(db^2)) + 1e-8).

    Deviations are taken once per image; a pair then is one sum of products.
    """
    dev = frames.select(by, "frame", A.let(A.array_mean(F.col("px")), lambda m: F.transform("px", lambda x: x - m)).alias("d"))
    dev = dev.withColumn("s", A.array_sum(F.transform("d", lambda x: x * x)))
    b = dev.select(by, F.col("frame").alias("other"), F.col("d").alias("d2"), F.col("s").alias("s2"))
    dot = A.array_sum(F.zip_with("d", "d2", lambda x, y: x * y))
    return dev.join(b, by).filter("frame <> other").select(by, "frame", "other", (dot / (F.sqrt(F.col("s") * F.col("s2")) + 1e-8)).alias("corr"))


def most_correlated(corr: DataFrame, by: str, most: int) -> DataFrame:
    """With `rank`, the `most` other frames of each frame, highest correlation first; ties by frame number."""
    w = Window.partitionBy(by, "frame").orderBy(F.desc("corr"), "other")
    return corr.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


#: Images of a block at most, and bytes of their pixels.
BLOCK_IMAGES, BLOCK_BYTES = 16384, 32 * 2**20


def block_size(pixels: int, block_bytes: int = BLOCK_BYTES) -> int:
    return max(1, min(BLOCK_IMAGES, block_bytes // (8 * max(1, pixels))))


def pairs_of_blocks(rows: DataFrame) -> DataFrame:
    """Each row (block, blocks) once for every pair (i, j), i <= j, of blocks that its own is in."""
    return rows.withColumn("__to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumns({"i": F.least("block", "__to"), "j": F.greatest("block", "__to")}).drop("__to")


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A column of arrays of one length as rows."""
    flat = column.combine_chunks()
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def best_correlated(frames: DataFrame, by: str, most: int, block: int | None = None, digits: int = 15) -> DataFrame:
    """What `most_correlated` makes of `correlations` rounded to `digits`, without a row per pair: blocks of images meet, each pair of blocks once, and each keeps the `most` best of every image. Products are matrix products of tiles; a task holds two blocks."""
    spark = frames.sparkSession
    ship(spark)
    kind, number = (frames.schema[c].dataType.simpleString() for c in (by, "frame"))
    dev = frames.filter(F.col(by).isNotNull()).select(by, F.col("frame").cast("long").alias("frame"), A.let(A.array_mean(F.col("px")), lambda m: F.transform("px", lambda x: x - m)).alias("d"))
    sizes = dev.groupBy(F.col(by).alias("__by")).agg(F.count(F.lit(1)).alias("__n"), F.max(F.size("d")).alias("__px"))
    per = F.lit(block) if block else F.greatest(F.lit(1), F.least(F.lit(BLOCK_IMAGES), F.floor(F.lit(BLOCK_BYTES) / (8 * F.greatest(F.lit(1), F.col("__px"))))))
    dev = dev.join(sizes, F.col(by) == F.col("__by")).withColumn("blocks", F.ceil(F.col("__n") / per)).drop("__by", "__n", "__px")
    # equal frames are in one block
    dealt = pairs_of_blocks(dev.withColumn("block", F.pmod(F.xxhash64("frame"), F.col("blocks"))))

    def run(key, rows):
        at, f, d = rows["block"].to_numpy(), rows["frame"].to_numpy(), matrix(rows["d"])
        one, two = at == key[1].as_py(), at == key[2].as_py()
        (frame, other, corr), _ = best_of_blocks((f[one], d[one]), None if key[1].as_py() == key[2].as_py() else (f[two], d[two]), most, digits) if one.any() and two.any() else ((np.zeros(0, np.int64),) * 2 + (np.zeros(0),), 0)
        return pa.table({by: pa.array([key[0].as_py()] * len(frame), rows.schema.field(by).type), "frame": frame, "other": other, "corr": corr})

    made = dealt.groupBy(by, "i", "j").applyInArrow(run, f"{by} {kind}, frame long, other long, corr double")
    return most_correlated(made.withColumns({c: F.col(c).cast(number) for c in ("frame", "other")}) if number != "bigint" else made, by, most)


def entropy(values: np.ndarray) -> float:
    """Of 256 bins of rounded, clamped values; natural logarithm."""
    n = np.bincount(np.clip(np.rint(values), 0, 255).astype(int), minlength=256)
    p = n[n > 0] / n.sum()
    return float(-(p * np.log(p)).sum())


def first_descent(values: np.ndarray) -> int | None:
    """The least i >= 1 with values[i] < values[i - 1]."""
    down = np.flatnonzero(np.diff(values) < 0)
    return int(down[0]) + 1 if len(down) else None


def smoothed(values: np.ndarray) -> np.ndarray:
    """Means of three neighbours, of two at the ends."""
    k = np.convolve(values, np.ones(3), "same")
    n = np.convolve(np.ones(len(values)), np.ones(3), "same")
    return k / n


def with_background(frames: DataFrame, background: DataFrame) -> DataFrame:
    """`frames` and column bg of a one-row background."""
    return frames.crossJoin(F.broadcast(background.select(F.col("px").alias("bg"))))


def remove_background(frames: DataFrame, background: DataFrame) -> DataFrame:
    """(v - bg) / max(sqrt(bg), 0.1), both in 0..1."""
    px = F.zip_with("px", "bg", lambda v, b: (v - b) / F.greatest(F.sqrt(b), F.lit(0.1)))
    return with_background(frames, background).withColumn("px", px).withColumn("mean_root", A.array_mean(F.transform("bg", F.sqrt))).drop("bg")


def divide_background(frames: DataFrame, background: DataFrame) -> DataFrame:
    """v / bg - 1; 0 where the background is 0."""
    return with_background(frames, background).withColumn("px", F.zip_with("px", "bg", lambda v, b: F.when(b != 0, v / b - 1).otherwise(0.0))).drop("bg")


def subtract_background(frames: DataFrame, background: DataFrame, alpha: float, beta: float, low: float = 0.0) -> DataFrame:
    """(v - bg - mean(v - bg) - alpha) beta + low, in 0..255."""
    rest = F.zip_with("px", "bg", lambda v, b: v - b)
    out = A.let(rest, lambda r: A.let(A.array_mean(r), lambda m: F.transform(r, lambda x: A.saturate((x - m - alpha) * beta + low, 0, 255))))
    return with_background(frames, background).withColumn("px", out).drop("bg")


def background_for(frames: DataFrame, backgrounds: DataFrame, how: str, last: int | None = None) -> DataFrame:
    """Which background file a frame uses: `same` (its own), `static` (the highest numbered), or `trailing` (its own, or the last for later frames); without one of its own, the highest numbered."""
    key = {"same": F.col("frame"), "static": F.lit(None).cast("long"), "trailing": F.least(F.col("frame"), F.lit(last))}[how]
    top = backgrounds.agg(F.max_by("path", "number").alias("top"))
    return frames.withColumn("number", key).join(backgrounds, "number", "left").crossJoin(F.broadcast(top)).withColumn("path", F.coalesce("path", "top")).drop("top", "number")


def windowed(frames: DataFrame, taper: float) -> DataFrame:
    """Images under a separable tapered cosine window."""
    n = lambda c: F.col(c).cast("double") - 1
    edge = lambda u: 0.5 * (1 - F.cos(2 * np.pi / taper * u))
    along = lambda i, c: F.when(n(c) > 0, F.least(i, n(c) - i) / n(c)).otherwise(0.5)
    factor = lambda t: F.when(t < taper / 2, edge(t)).otherwise(1.0)
    px = F.transform("px", lambda v, i: v * factor(along((i % F.col("w")).cast("double"), "w")) * factor(along(F.floor(i / F.col("w")).cast("double"), "h")))
    return frames.withColumn("px", px) if 0 < taper < 1 else frames


def regions(frames: DataFrame, points: DataFrame, size: int) -> DataFrame:
    """(frame, part, h, w, px): the square of `size` around each point (frame, part, x, y); what lies outside is 0. An image is joined once with all its points."""
    half = size // 2
    rows = points.select("frame", "part", (F.floor(F.col("x") + 0.5) - half).cast("int").alias("x0"), (F.floor(F.col("y") + 0.5) - half).cast("int").alias("y0"))
    # named apart, as a new column called w would be taken for the image's in the same projection
    out = rows.join(frames.select("frame", F.col("h").alias("fh"), F.col("w").alias("fw"), "px"), "frame")
    x, y = (lambda i: F.col("x0") + F.pmod(i, F.lit(size))), (lambda i: F.col("y0") + F.floor(i / size).cast("int"))
    inside = lambda i: (x(i) >= 0) & (x(i) < F.col("fw")) & (y(i) >= 0) & (y(i) < F.col("fh"))
    px = F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda i: F.when(inside(i), F.get("px", (y(i) * F.col("fw") + x(i)).cast("int"))).otherwise(0.0))
    return out.select("frame", "part", F.lit(size).alias("h"), F.lit(size).alias("w"), px.alias("px"))


def image_entropy(frames: DataFrame) -> DataFrame:
    """(frame, entropy) of 256 bins of rounded, clamped values; one image is one row, so its bins are counted in place."""
    counts = A.let(F.array_sort(F.transform("px", A.eight_bit)), lambda s: F.transform(F.array_distinct(s), lambda g: F.size(F.filter(s, lambda x: x == g)) / F.size(s)))
    return frames.select("frame", (-A.array_sum(F.transform(counts, lambda p: p * F.log(p)))).alias("entropy"))


def range_of(frames: DataFrame) -> DataFrame:
    return frames.select("frame", F.array_min("px").alias("lo"), F.array_max("px").alias("hi"))


def sequence_backgrounds(frames: DataFrame, by: str) -> DataFrame:
    """(by, h, w, bg): the mean image of each sequence, whose images have one size; a row is bounded by that size."""
    image = F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "bg"))), lambda c: c["bg"])
    return mean_background(frames, by).groupBy(by).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"), image.alias("bg"))


#: Bytes of backgrounds that are broadcast; more are joined by sequence, the images of each dealt to `SALTS` tasks.
BROADCAST_BYTES, SALTS = 64 * 2**20, 16


def with_sequence_background(frames: DataFrame, backgrounds: DataFrame, by: str, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """`frames` with the columns of their sequence's row of `backgrounds` (a written table of `by`, bg and others)."""
    size = backgrounds.agg(F.coalesce(F.sum(F.size("bg")), F.lit(0))).first()[0] * 8
    right = backgrounds.withColumnRenamed(by, "__by").drop("h", "w")
    if size <= broadcast_bytes:
        return frames.join(F.broadcast(right), F.col(by).eqNullSafe(F.col("__by"))).drop("__by")
    salted = frames.withColumn("__salt", F.pmod(F.xxhash64("frame"), F.lit(SALTS)).cast("int"))
    copies = right.withColumn("__to", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    same = F.col(by).eqNullSafe(F.col("__by")) & (F.col("__salt") == F.col("__to"))
    return salted.join(copies, same).drop("__by", "__salt", "__to")


def sequence_stats(frames: DataFrame, backgrounds: DataFrame, by: str, spread: float = 5.0, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(by, n, alpha, beta, minimum, average): `background_stats` of each sequence and how many images it has; beta is 0 where all images are the background."""
    rest = F.zip_with("px", "bg", lambda a, b: a - b)
    per = with_sequence_background(frames, backgrounds, by, broadcast_bytes).select(by, rest.alias("rest"), F.array_min("bg").alias("least"), A.array_mean(F.col("bg")).alias("mean"))
    per = per.select(by, "least", "mean", A.array_mean(F.col("rest")).alias("m"), A.array_std(F.col("rest")).alias("s"))
    wide = F.avg("s")
    return per.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), (F.avg("m") - spread * wide).alias("alpha"), F.when(wide > 0, 255 / (2 * spread * wide)).otherwise(0.0).alias("beta"),
        F.min("least").alias("minimum"), F.min("mean").alias("average"),
    )


def enhance_sequences(frames: DataFrame, backgrounds: DataFrame, by: str, low: float = 0.0, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """`frames` with px as `subtract_background` makes it from their sequence's bg, alpha and beta."""
    rest = F.zip_with("px", "bg", lambda v, b: v - b)
    joined = with_sequence_background(frames, backgrounds, by, broadcast_bytes)
    out = A.let(rest, lambda r: A.let(A.array_mean(r), lambda m: F.transform(r, lambda x: A.saturate((x - m - F.col("alpha")) * F.col("beta") + low, 0, 255))))
    return joined.withColumn("px", out).select(*frames.columns)
