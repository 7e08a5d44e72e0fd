"""Registered queries of files and sinks: parameter files, image sequences, and what is written of each frame."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import frames as fr
from ..operators import volume
from ..sources import parameters, regions, sequence, sinks
from ..tables import new_path
from .catalog import FRAMES_SQL, ORACLES, VOXELS_SQL, H, W, frames, query, read, voxels

_CODES = ", ".join(f"({i}, {p.code}, '{p.name}', '{p.kind}')" for i, p in enumerate(parameters.CODES))
_N = len(parameters.CODES)


@query(f"""WITH reg(i, code, setting_name, kind) AS (VALUES {_CODES}),
l AS (SELECT s_suppkey AS k, s_name AS name, coalesce(code, 99)::INT AS code, setting_name, kind, floor(abs(s_acctbal))::BIGINT AS n
  FROM supplier LEFT JOIN reg ON reg.i = s_suppkey % {_N + 2}),
v AS (SELECT *, CASE WHEN k % 7 = 0 THEN NULL WHEN k % 5 = 0 THEN n + 0.5 ELSE n END::DOUBLE AS num,
  CASE WHEN k % 7 = 0 THEN 'true' WHEN k % 5 = 0 THEN n::VARCHAR || '.5 more' ELSE n::VARCHAR || ' shot_%05d.tif' END AS said FROM l),
b AS (SELECT *, CASE WHEN k % 11 = 0 THEN 'not a name, a code and a value' WHEN kind IS NULL THEN 'no such code' WHEN kind IN ('number', 'whole') AND num IS NULL THEN 'not a number'
  WHEN kind = 'whole' AND num <> floor(num) THEN 'not a whole number' WHEN kind = 'flag' AND num IS NULL AND said <> 'true' THEN 'not a flag' END AS broken FROM v)
SELECT CASE WHEN k % 11 <> 0 THEN name END AS name, CASE WHEN k % 11 <> 0 THEN code END AS code, CASE WHEN k % 11 <> 0 THEN setting_name END AS setting_name, CASE WHEN k % 11 <> 0 THEN kind END AS kind,
  CASE WHEN broken IS NULL AND kind IN ('number', 'whole') THEN num END AS number, CASE WHEN broken IS NULL AND kind = 'text' THEN said END AS text,
  CASE WHEN broken IS NULL AND kind = 'flag' THEN said = 'true' OR num <> 0 END AS flag, broken FROM b""")
def file_parameters(spark, d):
    path = new_path(spark, "parameters")
    codes = F.array(*[F.lit(p.code) for p in parameters.CODES], F.lit(99), F.lit(99))
    k, n = F.col("s_suppkey"), F.floor(F.abs("s_acctbal")).cast("string")
    said = F.when(k % 7 == 0, "true").when(k % 5 == 0, F.concat(n, F.lit(".5 more"))).otherwise(F.concat(n, F.lit(" shot_%05d.tif")))
    line = F.when(k % 11 == 0, "only a name").otherwise(F.concat_ws(" ", F.regexp_replace("s_name", " ", "_"), F.get(codes, (k % (_N + 2)).cast("int")).cast("string"), said))
    read(spark, d, "supplier").select(F.explode(F.array(line, F.lit("% a remark"), F.lit(""))).alias("value")).write.text(path)
    return parameters.read_parameters(spark, path).select("name", "code", "setting_name", "kind", "number", "text", "flag", "broken")


@query(f"WITH {FRAMES_SQL} SELECT frame, y, x, v FROM px WHERE frame BETWEEN 20 AND 119 AND frame <> 50")
def sequence_scan(spark, d):
    """Frames of a sequence of TIFF files, written from tasks and scanned by number."""
    path = new_path(spark, "sequence")
    sequence.write_sequence(frames(spark, d), path)
    return fr.pixels(sequence.read_sequence(spark, path).filter("frame between 20 and 119 and frame <> 50")).select("frame", "y", "x", "v")


@query(f"WITH {FRAMES_SQL} SELECT frame, y, x, round(1 - v / avg(v) OVER (PARTITION BY frame), 6) AS v FROM px")
def sequence_load_inverse(spark, d):
    """All frames of a sequence of PNG files, loaded as 1 - v / mean."""
    path = new_path(spark, "sequence")
    sequence.write_sequence(frames(spark, d), path, "frame_%06d.png")
    return fr.pixels(sequence.read_sequence(spark, path, "inverse")).select("frame", "y", "x", F.round("v", 6).alias("v"))


@query(f"WITH {FRAMES_SQL} SELECT frame, y, x, least(255.0, greatest(0.0, round_even((v - 100) * 255 / (200 - 100), 0))) AS v FROM px")
def sequence_scaled(spark, d):
    """Images written with an explicit range."""
    path = new_path(spark, "scaled")
    sequence.write_sequence(frames(spark, d), path, scale=(100, 200))
    return fr.pixels(sequence.read_sequence(spark, path)).select("frame", "y", "x", "v")


@query(ORACLES["roi_scan"])
def file_regions(spark, d):
    """Squares around the brightest pixels, read from the files of a sequence."""
    path = new_path(spark, "sequence")
    f = frames(spark, d)
    sequence.write_sequence(f, path)
    at = (F.array_position("px", F.array_max("px")) - 1).cast("int")
    points = f.select("frame", F.lit(0).alias("part"), (at % 8).cast("double").alias("x"), F.floor(at / 8).cast("double").alias("y"))
    return fr.pixels(regions.read_regions(spark, path, points, 4)).select("frame", "y", "x", "v")


_FIELD = f"""WITH {VOXELS_SQL}, cells AS (SELECT f.frame, z.z, y.y, x.x FROM (SELECT DISTINCT frame FROM vox) f, (SELECT DISTINCT frame, z FROM vox) z, range(0, {H}) y(y), range(0, {W}) x(x) WHERE z.frame = f.frame),
c AS (SELECT frame, z, y, x, coalesce(re, 0) AS re, CASE WHEN re IS NULL THEN 0 ELSE x - 16.0 END AS im FROM cells LEFT JOIN vox USING (frame, z, y, x)),
m AS (SELECT *, sqrt(re * re + im * im) AS mag, CASE WHEN atan2(im, re) < 0 THEN atan2(im, re) + 2 * pi() ELSE atan2(im, re) END AS phase FROM c),
s AS (SELECT *, min(mag) OVER (PARTITION BY frame) AS lo, max(mag) OVER (PARTITION BY frame) AS hi FROM m)
SELECT frame, z AS z_idx, y, x, """


def _field(spark, d):
    return volume.to_planes(voxels(spark, d).withColumn("im", F.col("x") - F.lit(16.0)), W, H).withColumnRenamed("z", "z_idx")


@query(_FIELD + "round_even((mag - lo) / (hi - lo) * 255, 0) AS v, round_even(abs(phase - pi()) / pi() * 255, 0) AS p FROM s")
def sink_planes(spark, d):
    """Planes of complex volumes as images of magnitude and of phase."""
    path = new_path(spark, "plane-images")
    sinks.write_planes(_field(spark, d), path)
    cells = lambda kind, name: sinks.read_planes(spark, path, kind).select("frame", "z_idx", "w", F.posexplode("px").alias("i", name))
    both = cells("plane", "v").join(cells("phase_plane", "p"), ["frame", "z_idx", "w", "i"])
    return both.select("frame", "z_idx", F.expr("i div w").cast("int").alias("y"), (F.col("i") % F.col("w")).alias("x"), "v", "p")


@query(f"WITH {VOXELS_SQL} SELECT frame, z, y, x, re AS value FROM vox WHERE re <> 0")
def sink_nonzeros(spark, d):
    """Cells of dense planes that aren't zero, as lines."""
    path = new_path(spark, "nonzeros")
    sinks.write_nonzeros(volume.to_planes(voxels(spark, d), W, H).withColumnRenamed("z", "z_idx"), path)
    return sinks.read_nonzeros(spark, path)


@query("""SELECT o_custkey % 40 AS frame, row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY o_orderkey)::INT AS it, round(o_totalprice, 2) AS f,
  round(o_totalprice / (o_totalprice + 1000), 6) AS sparsity, o_orderkey / 8.0 AS stepsize, (o_orderkey % 3)::INT AS total_backtracks FROM orders""")
def sink_metrics(spark, d):
    """Iteration tables of many frames, of which some are written again."""
    path = new_path(spark, "metrics")
    it = F.row_number().over(Window.partitionBy(F.col("o_custkey") % 40).orderBy("o_orderkey"))
    rows = read(spark, d, "orders").select(
        (F.col("o_custkey") % 40).alias("frame"), it.alias("it"), F.round("o_totalprice", 2).alias("f"), F.round(F.col("o_totalprice") / (F.col("o_totalprice") + 1000), 6).alias("sparsity"),
        (F.col("o_orderkey") / 8).alias("stepsize"), (F.col("o_orderkey") % 3).cast("int").alias("total_backtracks"),
    )
    sinks.write_metrics(rows, path)
    sinks.write_metrics(rows.filter("frame % 2 = 0"), path)
    return sinks.read_metrics(spark, path)


@query(f"""WITH {FRAMES_SQL} SELECT seq::BIGINT AS frame, y::INT AS z_idx, sum(v) AS raw_real, -sum(v * x) AS raw_imag FROM px GROUP BY ALL""")
def sink_focus_text(spark, d):
    """Focus values as text."""
    path = new_path(spark, "focus")
    rows = fr.pixels(frames(spark, d), "seq").groupBy(F.col("seq").alias("frame"), F.col("y").alias("z_idx")).agg(F.sum("v").alias("raw_real"), (-F.sum(F.col("v") * F.col("x"))).alias("raw_imag"))
    sinks.write_focus_text(rows, path)
    return sinks.read_focus_text(spark, path)


