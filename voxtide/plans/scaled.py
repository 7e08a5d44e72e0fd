"""Registered queries of operators that cut what is large into parts: correlation by bounds, tracks in time ranges, blocks with borders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import blocks, correlated, ranges, tiles, tracking
from ..operators import frames as fr
from ..streaming import live
from .catalog import FRAMES_SQL, LINKING, ORACLES, VOXELS_SQL, D, H, W, _stream, frames, points, query, voxels


@query(ORACLES["bg_corr_topk"])
def bg_corr_topk_bounded(spark, d):
    """The rows of bg_corr_topk, with few pairs computed."""
    return correlated.best_correlated_bounded(frames(spark, d), "seq", 5, factor=4, digits=6).best


def _background_sql(side: int) -> str:
    """Backgrounds of images whose pixels are averaged over squares of `side` for the search."""
    n = (8 // side) ** 2
    return f"""WITH {FRAMES_SQL}, sm AS (SELECT seq, frame, y // {side} AS y, x // {side} AS x, avg(v) AS v FROM px GROUP BY ALL),
d AS (SELECT *, v - avg(v) OVER (PARTITION BY frame) AS d FROM sm), s AS (SELECT frame, sum(d * d) AS s FROM d GROUP BY frame),
c AS (SELECT a.seq, a.frame, b.frame AS other, sum(a.d * b.d) AS ab FROM d a JOIN d b ON a.seq = b.seq AND a.y = b.y AND a.x = b.x AND a.frame <> b.frame GROUP BY ALL),
r AS (SELECT c.seq, c.frame, other, round(ab / (sqrt(p.s * q.s) + 1e-8), 6) AS corr FROM c JOIN s p ON p.frame = c.frame JOIN s q ON q.frame = other),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seq, frame ORDER BY corr DESC, other) AS rank FROM r) WHERE rank <= 8),
run AS (SELECT k.frame, k.rank, o.y, o.x, sum(o.v) OVER (PARTITION BY k.frame, o.y, o.x ORDER BY k.rank) / k.rank AS m FROM k JOIN sm o ON o.frame = other),
h AS (SELECT frame, rank, least(255, floor(greatest(sm.v - m, 0) + 0.5)) AS b, count(*) AS n FROM run JOIN sm USING (frame, y, x) GROUP BY ALL),
e AS (SELECT frame, rank, -sum(n / {n}.0 * ln(n / {n}.0)) AS e FROM h GROUP BY ALL),
e3 AS (SELECT frame, rank, avg(e) OVER (PARTITION BY frame ORDER BY rank ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS e FROM e),
g AS (SELECT frame, rank, e - lag(e) OVER (PARTITION BY frame ORDER BY rank) < -1e-9 AS falls FROM e3),
u AS (SELECT frame, least(max(rank), greatest(3 - 1, least(coalesce(min(rank - 1) FILTER (falls), 1), max(rank) - 1)) + 1) AS used FROM g GROUP BY frame)
SELECT k.seq, k.frame, used::INT AS used, px.y, px.x, round(avg(v), 6) AS bg FROM k JOIN u USING (frame) JOIN px ON px.frame = k.other WHERE k.rank <= used GROUP BY ALL"""


def _background(spark, d, share):
    made = correlated.correlation_background(frames(spark, d), "seq", 3, 8, share, digits=6).withColumn("w", F.lit(8))
    return fr.pixels(made, "seq", "used").select("seq", "frame", "used", "y", "x", F.round("v", 6).alias("bg"))


@query(_background_sql(1))
def bg_correlation(spark, d):
    return _background(spark, d, 1.0)


@query(_background_sql(4))
def bg_correlation_resized(spark, d):
    """Correlated and chosen on images of a quarter of the size, averaged whole."""
    return _background(spark, d, 0.25)


@query()
def track_link_ranges(spark, d):
    """Tracks of the one sequence of all particles, linked in time ranges."""
    return ranges.link_long(tracking.usable(points(spark, d), LINKING), LINKING)


def _box_sql(wide: int, high: int) -> str:
    over = lambda part, order, n: f"(PARTITION BY frame, {part} ORDER BY {order} ROWS BETWEEN {(n - 1) // 2} PRECEDING AND {n // 2} FOLLOWING)"
    return f"""WITH {FRAMES_SQL}, a AS (SELECT frame, y, x, sum(v) OVER w AS s, count(*) OVER w AS n FROM px WINDOW w AS {over("y", "x", wide)})
SELECT frame, y, x, round(sum(s) OVER w / sum(n) OVER w, 6) AS v FROM a WINDOW w AS {over("x", "y", high)}"""


def _box(spark, d, wide, high):
    return blocks.box_mean(frames(spark, d), wide, high).select("frame", "y", "x", F.round("v", 6).alias("v"))


@query(_box_sql(3, 3))
def box_mean_3x3(spark, d):
    return _box(spark, d, 3, 3)


@query(_box_sql(6, 5))
def box_mean_6x5(spark, d):
    return _box(spark, d, 6, 5)


def _tv_sql(axes: str, weight: float, steps: int) -> str:
    """Dual steps written out: periodic differences are windows along an axis whose first row goes on from the last."""
    rate = 1 / (4 * len(axes))
    part = {a: ", ".join(["frame", *[b for b in "zyx" if b != a]]) for a in axes}
    before = lambda v, a: f"({v} - coalesce(lag({v}) OVER (PARTITION BY {part[a]} ORDER BY {a}), last_value({v}) OVER (PARTITION BY {part[a]} ORDER BY {a} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)))"
    after = lambda v, a: f"({v} - coalesce(lead({v}) OVER (PARTITION BY {part[a]} ORDER BY {a}), first_value({v}) OVER (PARTITION BY {part[a]} ORDER BY {a} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)))"
    out = [f"WITH {VOXELS_SQL}, s0 AS (SELECT f.frame, z.z, y.y, x.x, coalesce(re, 0.0) AS v, {', '.join(f'0.0 AS g{a}' for a in axes)} FROM (SELECT DISTINCT frame FROM vox) f, range(0, {D}) z(z), range(0, {H}) y(y), range(0, {W}) x(x) LEFT JOIN vox ON vox.frame = f.frame AND vox.z = z.z AND vox.y = y.y AND vox.x = x.x)"]
    for k in range(steps):
        gs = ", ".join(f"g{a}" for a in axes)
        out.append(f"u{k} AS (SELECT frame, z, y, x, v, {gs}, v - {weight} * ({' + '.join(after(f'g{a}', a) for a in axes)}) AS u FROM s{k})")
        out.append(f"p{k} AS (SELECT frame, z, y, x, v, {', '.join(f'g{a} + {rate / weight!r} * {before("u", a)} AS g{a}' for a in axes)} FROM u{k})")
        out.append(f"s{k + 1} AS (SELECT frame, z, y, x, v, {', '.join(f'g{a} / greatest(1, sqrt({" + ".join(f"g{b} * g{b}" for b in axes)})) AS g{a}' for a in axes)} FROM p{k})")
    last = f"SELECT frame, z, y, x, v - {weight} * ({' + '.join(after(f'g{a}', a) for a in axes)}) AS re FROM s{steps}"
    return ", ".join(out) + f" SELECT frame, z, y, x, round(re, 5) + 0.0 AS re FROM ({last}) WHERE abs(re) > 1e-6"


def _tv(spark, d, how, steps):
    # blocks that are small and don't divide the volume, and two exchanges
    made = blocks.denoise(voxels(spark, d), 2.0, W, H, D, how, steps, together=2, block=(5, 16, 12))
    return made.filter("abs(re) > 1e-6").select("frame", "z", "y", "x", (F.round("re", 5) + F.lit(0.0)).alias("re"))


@query(_tv_sql("zyx", 2.0, 3))
def tv_denoise_volume(spark, d):
    """Three-dimensional dual steps in blocks."""
    return _tv(spark, d, "volume", 3)


@query(_tv_sql("z", 2.0, 4))
def tv_denoise_z(spark, d):
    """Dual steps along z in blocks."""
    return _tv(spark, d, "z", 4)


@query(_tv_sql("yx", 2.0, 3))
def tv_denoise_planes(spark, d):
    """Dual steps in planes, in blocks."""
    return _tv(spark, d, "planes", 3)


@query()
def h_maxima_blocks(spark, d):
    """The h-maxima transform in blocks that exchange borders."""
    return blocks.h_maxima(voxels(spark, d), 5.0, W, H, D, block=(4, 16, 16))


@query(f"""WITH {FRAMES_SQL}, t AS (SELECT i FROM range(0, 3) t(i))
SELECT frame, ty.i::INT AS ty, tx.i::INT AS tx, y, x, v, ty.i = y // 3 AND tx.i = x // 3 AS owned
FROM px JOIN t ty ON y >= ty.i * 3 - 2 AND y < ty.i * 3 + 5 JOIN t tx ON x >= tx.i * 3 - 2 AND x < tx.i * 3 + 5""")
def image_tiles(spark, d):
    """Images as tiles that overlap, each cell owned by one."""
    rows = tiles.cut(frames(spark, d), 3, 2).select("frame", "ty", "tx", "y0", "x0", "tw", F.posexplode("px").alias("i", "v"))
    rows = rows.select("frame", "ty", "tx", (F.col("y0") + F.expr("i div tw")).cast("int").alias("y"), (F.col("x0") + F.col("i") % F.col("tw")).alias("x"), "v")
    return rows.withColumn("owned", (F.expr("y div 3") == F.col("ty")) & (F.expr("x div 3") == F.col("tx")))


@query()
def detect_particles_tiled(spark, d):
    """Detections of detect_particles, made on tiles."""
    return tiles.detections(frames(spark, d).withColumn("px", A.stretch(F.col("px"))), 5, blur=2, anchor=0, opening=0)


@query(f"""WITH {FRAMES_SQL}, f AS (SELECT seq, frame, idx, y, x, list(v) OVER (PARTITION BY seq, y, x ORDER BY frame ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS l FROM px)
SELECT seq, frame, y, x, list_sort(l)[3] AS v FROM f WHERE idx >= 4""")
def stream_background_state(spark, d):
    """Rolling medians on a stream whose state is a map of the last images."""
    rows = frames(spark, d).select("seq", "frame", "px")
    out = live.run_once(spark, live.rolling_background_state(_stream(spark, rows), "seq"), settings=live.STATE)
    return fr.pixels(out.withColumn("w", F.lit(8)), "seq").select("seq", "frame", "y", "x", "v")
