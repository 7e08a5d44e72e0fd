"""Projections, norms, histograms and thresholds of sparse volumes.

A volume is rows of `voxels` (frame, z, y, x, re, im), one per non-zero. Norms and counts are one aggregate each,
combined before the shuffle. Differences between neighbouring cells are made by sending a voxel to the cells it takes
part in and grouping by cell, which is one shuffle for all axes where a join per axis would be three.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.arrays import magnitude, phase, soft_threshold


def power() -> Column:
    return F.col("re") * F.col("re") + F.col("im") * F.col("im")


def mag() -> Column:
    return magnitude(F.col("re"), F.col("im"))


PLANES = {"xy": ("y", "x"), "xz": ("z", "x"), "yz": ("z", "y")}


def projection(voxels: DataFrame, plane: str, how: str = "max", skip_first: bool | None = None) -> DataFrame:
    """(frame, two axes, v): the greatest or least magnitude along the third axis; xy leaves out z = 0 unless told otherwise."""
    skip = plane == "xy" if skip_first is None else skip_first
    rows = voxels.filter("z > 0") if skip else voxels
    return rows.groupBy("frame", *PLANES[plane]).agg((F.max if how == "max" else F.min)(mag()).alias("v"))


def projections(voxels: DataFrame, how: str = "max") -> DataFrame:
    """All three in one pass: (frame, plane, z, y, x, v), null along the axis that is gone; xy leaves out z = 0."""
    agg = (F.max if how == "max" else F.min)(mag())
    sets = voxels.groupingSets([[F.col("frame"), F.col("z"), F.col("x")], [F.col("frame"), F.col("z"), F.col("y")]], "frame", "z", "y", "x").agg(agg.alias("v"))
    side = sets.withColumn("plane", F.when(F.col("y").isNull(), F.lit("xz")).otherwise(F.lit("yz")))
    top = projection(voxels, "xy", how).select("frame", F.lit("xy").alias("plane"), F.lit(None).cast("int").alias("z"), "y", "x", "v")
    return top.unionByName(side.select("frame", "plane", "z", "y", "x", "v"))


def arg_plane(voxels: DataFrame) -> DataFrame:
    """(frame, y, x, v, z): the greatest power along z and where it is, the higher plane on a tie."""
    best = F.max(F.struct(power().alias("v"), "z")).alias("b")
    return voxels.groupBy("frame", "y", "x").agg(best).select("frame", "y", "x", "b.v", "b.z")


def scaled_projection(projected: DataFrame) -> DataFrame:
    """A projection as 8-bit values between the least and greatest of its frame."""
    w = Window.partitionBy("frame")
    lo, hi = F.min("v").over(w), F.max("v").over(w)
    return projected.withColumn("grey", F.when(hi > lo, F.rint(255 * (F.col("v") - lo) / (hi - lo))).otherwise(0.0).cast("int"))


def plane_counts(voxels: DataFrame) -> DataFrame:
    return voxels.groupBy("frame", "z").agg(F.count(F.lit(1)).alias("nnz"))


def norms(voxels: DataFrame, w: int, h: int, d: int) -> DataFrame:
    """Per frame: nnz, sparsity, greatest power, sums of powers, magnitudes and absolute components, and of re and im."""
    return voxels.groupBy("frame").agg(
        F.count(F.lit(1)).alias("nnz"),
        (F.count(F.lit(1)) / F.lit(float(w * h * d))).alias("sparsity"),
        F.max(power()).alias("max_power"),
        F.sum(power()).alias("l2_squared"),
        F.sum(mag()).alias("l1"),
        F.sum(F.abs("re") + F.abs("im")).alias("l1_parts"),
        F.sum("re").alias("sum_re"),
        F.sum("im").alias("sum_im"),
    )


def mean_std(voxels: DataFrame, cells: int) -> DataFrame:
    """Per frame over all `cells`, zeros included: mean = sum / (n - 1), std = sqrt(sum of squares / (n - 1) - mean^2) of the real part."""
    mean = F.sum("re") / F.lit(float(cells - 1))
    return voxels.groupBy("frame").agg(mean.alias("mean"), F.sqrt(F.greatest(F.sum(F.col("re") * F.col("re")) / F.lit(float(cells - 1)) - mean * mean, F.lit(0.0))).alias("std"))


def total_variation(voxels: DataFrame, w: int, h: int, d: int, axes: str = "xyz", per: tuple[str, ...] = ("frame",)) -> DataFrame:
    """(per, tv): sum over cells of the root of the squared backward differences along `axes`, periodic."""
    size = {"x": w, "y": h, "z": d}
    cells = [F.struct(F.lit("o").alias("part"), "z", "y", "x")]
    for a in axes:
        moved = [F.pmod(F.col(c) + 1, F.lit(size[c])).cast("int").alias(c) if c == a else F.col(c).cast("int").alias(c) for c in "zyx"]
        cells.append(F.struct(F.lit(a).alias("part"), *moved))
    cells[0] = F.struct(F.lit("o").alias("part"), *[F.col(c).cast("int").alias(c) for c in "zyx"])
    sent = voxels.select("frame", "re", "im", F.explode(F.array(*cells)).alias("c"))
    of = lambda k, v: F.coalesce(F.sum(F.when(F.col("c.part") == k, F.col(v))), F.lit(0.0))
    each = sum(((of("o", v) - of(a, v)) ** 2 for a in axes for v in ("re", "im")), F.lit(0.0))
    met = sent.groupBy("frame", F.col("c.z").alias("z"), F.col("c.y").alias("y"), F.col("c.x").alias("x")).agg(F.sqrt(each).alias("g"))
    return met.groupBy(*per).agg(F.sum("g").alias("tv"))


def binned(rows: DataFrame, value: str, bins: int, *by: str) -> DataFrame:
    """`rows` with lo, hi and bin (0-based) of `bins` equal bins between the least and greatest value of `by`; the greatest lies in the last."""
    ends = rows.groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    joined = rows.join(ends, list(by)) if by else rows.crossJoin(F.broadcast(ends))
    at = F.floor((F.col(value) - F.col("lo")) * F.lit(float(bins)) / (F.col("hi") - F.col("lo")))
    return joined.withColumn("bin", F.when(F.col("hi") > F.col("lo"), F.least(at, F.lit(bins - 1))).otherwise(0).cast("int"))


def histogram(rows: DataFrame, value: str, bins: int, *by: str) -> DataFrame:
    """(by, bin, begin, end, n); empty bins have no row."""
    made = binned(rows, value, bins, *by).groupBy(*by, "bin", "lo", "hi").agg(F.count(F.lit(1)).alias("n"))
    step = (F.col("hi") - F.col("lo")) / bins
    return made.select(*by, "bin", (F.col("lo") + F.col("bin") * step).alias("begin"), (F.col("lo") + (F.col("bin") + 1) * step).alias("end"), "n")


def entropy(counts: DataFrame, *by: str) -> DataFrame:
    """(by, entropy) of a histogram; natural logarithm."""
    total = F.sum("n").over(Window.partitionBy(*by))
    return counts.withColumn("p", F.col("n") / total).groupBy(*by).agg((-F.sum(F.col("p") * F.log("p"))).alias("entropy"))


def otsu(counts: DataFrame, *by: str) -> DataFrame:
    """(by, level, threshold) of a histogram: the bin that parts it with the greatest w_b w_f (m_b - m_f)^2, the lowest on a tie, and its upper edge."""
    w = Window.partitionBy(*by)
    o = w.orderBy("bin")
    run = counts.withColumns({"wb": F.sum("n").over(o), "sb": F.sum(F.col("n") * F.col("bin")).over(o), "wt": F.sum("n").over(w), "st": F.sum(F.col("n") * F.col("bin")).over(w)})
    wf = F.col("wt") - F.col("wb")
    gap = F.col("sb") / F.col("wb") - (F.col("st") - F.col("sb")) / wf
    between = F.when(wf > 0, F.col("wb") * wf * gap * gap).otherwise(0.0)
    best = F.max(F.struct(between.alias("v"), (-F.col("bin")).alias("m"), "end")).alias("b")
    return run.groupBy(*by).agg(best).select(*by, (-F.col("b.m")).alias("level"), F.col("b.end").alias("threshold"))


def mode_half(counts: DataFrame, *by: str) -> DataFrame:
    """(by, threshold): half of the fullest bin's number, the lowest on a tie."""
    best = F.max(F.struct("n", (-F.col("bin")).alias("m"))).alias("b")
    return counts.groupBy(*by).agg(best).select(*by, (-F.col("b.m") / 2).alias("threshold"))


def block_ids(c: Column, size: int, extent: int) -> Column:
    """The blocks, of `size` at half-size strides over 0..extent-1, that a coordinate lies in."""
    step = size // 2
    last = max(0, (extent - size) // step)
    first = F.greatest(F.lit(0), F.ceil((c - (size - 1)) / step))
    return F.sequence(first.cast("int"), F.least(F.floor(c / step), F.lit(last)).cast("int"))


def _in_block(axes: dict[str, int], size: int) -> Column:
    """Some cell of an axis may lie beyond the last block."""
    out = F.lit(True)
    for a, extent in axes.items():
        last = max(0, (extent - size) // (size // 2))
        out = out & (F.col(a) < last * (size // 2) + size)
    return out


def block_stats(rows: DataFrame, value: str, axes: dict[str, int], size: int, *by: str) -> DataFrame:
    """(by, block per axis, lo, hi, mean, std, n) of overlapping blocks; std is of the sample."""
    out = rows.filter(_in_block(axes, size))
    for a, extent in axes.items():
        out = out.withColumn(f"b{a}", F.explode(block_ids(F.col(a), size, extent)))
    keys = [*by, *(f"b{a}" for a in axes)]
    return out.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(F.lit(1)).alias("n"))


def block_normalize(rows: DataFrame, value: str, axes: dict[str, int], size: int, *by: str) -> DataFrame:
    """`rows` with `value` as (v - lo) / (hi - lo) of the block it is ranged with, min(c div half size, last); 1 where that is flat."""
    stats = block_stats(rows, value, axes, size, *by).select(*by, *(f"b{a}" for a in axes), "lo", "hi")
    step = size // 2
    keyed = rows.withColumns({f"b{a}": F.least(F.expr(f"{a} div {step}"), F.lit(max(0, (n - size) // step))).cast("int") for a, n in axes.items()})
    joined = keyed.join(stats, [*by, *(f"b{a}" for a in axes)], "left")
    scaled = F.when(F.col("hi") > F.col("lo"), (F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(1.0)
    return joined.withColumn(value, scaled).drop("lo", "hi", *(f"b{a}" for a in axes))


def snr_threshold(rows: DataFrame, value: str, axes: dict[str, int], size: int, *by: str) -> DataFrame:
    """(by, threshold) = mean(least of blocks) - mean(s) - std(s), s the sample deviations of overlapping blocks."""
    s = block_stats(rows, value, axes, size, *by)
    return s.groupBy(*by).agg((F.avg("lo") - F.avg("std") - F.coalesce(F.stddev_samp("std"), F.lit(0.0))).alias("threshold"))


def intensity_mask(voxels: DataFrame, least: float) -> DataFrame:
    """Voxels whose power exceeds least * (greatest power of the frame) / 256."""
    top = voxels.groupBy("frame").agg((F.max(power()) * least / 256).alias("cut"))
    return voxels.join(top, "frame").filter(power() > F.col("cut")).drop("cut")


def joined_volumes(a: DataFrame, b: DataFrame) -> DataFrame:
    """(frame, z, y, x, are, aim, bre, bim): both volumes cell by cell, zero where one has no voxel."""
    keys = ["frame", "z", "y", "x"]
    both = a.select(*keys, F.col("re").alias("are"), F.col("im").alias("aim")).join(b.select(*keys, F.col("re").alias("bre"), F.col("im").alias("bim")), keys, "full_outer")
    return both.na.fill(0.0, ["are", "aim", "bre", "bim"])


def combined(a: DataFrame, b: DataFrame, ka: float, kb: float) -> DataFrame:
    """ka * a + kb * b without cells that are zero: a gradient step, a momentum update, a residual."""
    out = joined_volumes(a, b).select("frame", "z", "y", "x", (ka * F.col("are") + kb * F.col("bre")).alias("re"), (ka * F.col("aim") + kb * F.col("bim")).alias("im"))
    return out.filter("re <> 0 or im <> 0")


def inner_products(a: DataFrame, b: DataFrame) -> DataFrame:
    """(frame, dot, diff2): sum of a.b over both components, and of |a - b|^2."""
    j = joined_volumes(a, b)
    dot = F.col("are") * F.col("bre") + F.col("aim") * F.col("bim")
    diff = (F.col("are") - F.col("bre")) ** 2 + (F.col("aim") - F.col("bim")) ** 2
    return j.groupBy("frame").agg(F.sum(dot).alias("dot"), F.sum(diff).alias("diff2"))


def line_search_limit(x1: DataFrame, x0: DataFrame, gradient: DataFrame, step: float) -> DataFrame:
    """(frame, bound) = <x1 - x0, g> + |x1 - x0|^2 / (2 step)."""
    move = combined(x1, x0, 1.0, -1.0)
    dot = inner_products(move, gradient).select("frame", "dot")
    size = move.groupBy("frame").agg(F.sum(power()).alias("s"))
    return dot.join(size, "frame", "left").select("frame", (F.col("dot") + F.coalesce("s", F.lit(0.0)) / (2 * step)).alias("bound"))


def shrink(voxels: DataFrame, t: float) -> DataFrame:
    """Soft threshold of each component; cells that become zero go."""
    out = voxels.withColumns({c: soft_threshold(F.col(c), t) for c in ("re", "im")})
    return out.filter("re <> 0 or im <> 0")


def denser_planes(voxels: DataFrame, factor: int) -> DataFrame:
    """Linear interpolation between neighbouring planes to `factor` times as many; a missing voxel counts as zero."""
    at = [F.struct((F.col("z") * factor + k).cast("int").alias("z"), F.lit(1 - abs(k) / factor).alias("share")) for k in range(-factor + 1, factor)]
    sent = voxels.select("frame", "y", "x", "re", "im", F.explode(F.array(*at)).alias("c")).filter("c.z >= 0")
    return sent.groupBy("frame", F.col("c.z").alias("z"), "y", "x").agg(F.sum(F.col("re") * F.col("c.share")).alias("re"), F.sum(F.col("im") * F.col("c.share")).alias("im"))


def to_planes(voxels: DataFrame, w: int, h: int) -> DataFrame:
    """Dense planes (frame, z, h, w, re, im) of the planes with voxels; a plane is one row, bounded by the image size."""
    lists = voxels.groupBy("frame", "z").agg(F.map_from_entries(F.collect_list(F.struct((F.col("y") * w + F.col("x")).alias("k"), F.struct("re", "im").alias("v")))).alias("m"))
    value = lambda part: F.transform(F.sequence(F.lit(0), F.lit(w * h - 1)), lambda i: F.coalesce(F.try_element_at("m", i)[part], F.lit(0.0)))
    return lists.select("frame", "z", F.lit(h).alias("h"), F.lit(w).alias("w"), value("re").alias("re"), value("im").alias("im"))


def from_planes(planes: DataFrame) -> DataFrame:
    """The non-zeros of dense planes."""
    rows = planes.select("frame", "z", "w", F.posexplode(F.arrays_zip("re", "im")).alias("pos", "v"))
    out = rows.select("frame", "z", F.expr("pos div w").cast("int").alias("y"), (F.col("pos") % F.col("w")).alias("x"), "v.re", "v.im")
    return out.filter("re <> 0 or im <> 0")


ELEMENTWISE = {
    "min": lambda a, b: F.least(a, b),
    "max": lambda a, b: F.greatest(a, b),
    "add": lambda a, b: a + b,
    "subtract": lambda a, b: a - b,
    "multiply": lambda a, b: a * b,
}


def elementwise(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Each component of two volumes combined cell by cell (a product is of components, not complex); zeros go."""
    f = ELEMENTWISE[how]
    j = joined_volumes(a, b)
    out = j.select("frame", "z", "y", "x", f(F.col("are"), F.col("bre")).alias("re"), f(F.col("aim"), F.col("bim")).alias("im"))
    return out.filter("re <> 0 or im <> 0")


def argmax_merge(*volumes: DataFrame) -> DataFrame:
    """(frame, z, y, x, v, id): the greatest real part over volumes numbered from 0 and which has it, the later on a tie."""
    rows = [v.select("frame", "z", "y", "x", "re", F.lit(i).alias("id")) for i, v in enumerate(volumes)]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    best = F.max(F.struct(F.col("re").alias("v"), "id")).alias("b")
    return out.groupBy("frame", "z", "y", "x").agg(best).select("frame", "z", "y", "x", "b.v", "b.id")


def broken_cells(voxels: DataFrame) -> DataFrame:
    """(frame, broken): whether a volume holds a value that isn't a number, or is infinite."""
    odd = lambda c: F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    return voxels.groupBy("frame").agg(F.bool_or(odd("re") | odd("im")).alias("broken"))


def complex_parts(voxels: DataFrame) -> DataFrame:
    """`voxels` with magnitude, phase in [0, 2 pi) and power."""
    return voxels.withColumns({"magnitude": mag(), "phase": phase(F.col("re"), F.col("im")), "power": power()})


def from_polar(rows: DataFrame) -> DataFrame:
    """re and im of magnitude and phase."""
    return rows.withColumns({"re": F.col("magnitude") * F.cos("phase"), "im": F.col("magnitude") * F.sin("phase")})


def recorded(voxels: DataFrame, background: float) -> DataFrame:
    """What a camera records of a field over a plane reference: |u|^2 + 2 sqrt(b) re + b."""
    return voxels.withColumn("v", power() + 2 * F.sqrt(F.lit(background)) * F.col("re") + background)


def masked_mean(rows: DataFrame, value: str, mask: Column, *by: str) -> DataFrame:
    """`rows` with `value` set, where the mask holds, to the mean over all rows of `by`."""
    return rows.withColumn(value, F.when(mask, F.avg(value).over(Window.partitionBy(*by))).otherwise(F.col(value)))


def nearest_plane(z: Column, every: int) -> Column:
    """The nearest of the planes that subsampling by `every` keeps, the lower on a tie."""
    return (F.ceil(z / every - 0.5) * every).cast("int")


def as_frames(rows: DataFrame, value: str, w: int, h: int) -> DataFrame:
    """Dense images (frame, h, w, px) of (frame, y, x, value), 0 where there is no row; an image is one group, bounded by its size."""
    cells = F.map_from_entries(F.collect_list(F.struct((F.col("y") * w + F.col("x")).alias("k"), F.col(value).cast("double").alias("v"))))
    px = F.transform(F.sequence(F.lit(0), F.lit(w * h - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    return rows.groupBy("frame").agg(cells.alias("m")).select("frame", F.lit(h).alias("h"), F.lit(w).alias("w"), px.alias("px"))


def objective(x: DataFrame, measured: DataFrame, l1: float) -> DataFrame:
    """(frame, fit, penalty, total): half the squared difference, l1 times the sum of absolute components of x, and both."""
    j = joined_volumes(x, measured)
    fit = 0.5 * F.sum((F.col("are") - F.col("bre")) ** 2 + (F.col("aim") - F.col("bim")) ** 2)
    penalty = l1 * F.sum(F.abs("are") + F.abs("aim"))
    return j.groupBy("frame").agg(fit.alias("fit"), penalty.alias("penalty"), (fit + penalty).alias("total"))
