"""The jobs as registered queries, with SQL for the same rows. Each runs its job twice into a folder of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from voxtide.tables import new_path

from . import enhance_images, sequence_index


def job1_enhance_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of backgrounds (without a frame) and of images, and the numbers of backgrounds (without a cell)."""
    folder = new_path(spark, "job1")
    for _ in range(2):
        enhance_images.run(spark, f"{sf_dir}/embeddings.parquet", folder)
    backgrounds, images = enhance_images.read_output(spark, folder)
    number = lambda c: F.struct(F.lit(c).alias("kind"), F.col(c).cast("double").alias("v"))
    cells = lambda px: [F.expr("pos div w").cast("int").alias("y"), (F.col("pos") % F.col("w")).alias("x"), F.round(px, 4).alias("v")]
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    bg = backgrounds.select("sequence", "w", F.posexplode("bg").alias("pos", "p")).select(F.lit("background").alias("kind"), "sequence", *none("long", "frame"), *cells("p"))
    px = images.select("sequence", "frame", "w", F.posexplode("px").alias("pos", "p")).select(F.lit("image").alias("kind"), "sequence", "frame", *cells("p"))
    said = backgrounds.select("sequence", F.explode(F.array(*[number(c) for c in ("n", "alpha", "beta", "minimum", "average")])).alias("s"))
    said = said.select("s.kind", "sequence", *none("long", "frame"), *none("int", "y", "x"), F.round("s.v", 4).alias("v"))
    return bg.unionByName(px).unionByName(said)


JOB1 = """
WITH raw AS (SELECT label::VARCHAR AS sequence, vec_id AS frame, embedding FROM embeddings),
px AS (
  SELECT sequence, frame, (p - 1) // 8 AS y, (p - 1) % 8 AS x, least(255.0, greatest(0.0, round_even(128 + 100 * embedding[p]::DOUBLE, 0))) AS v
  FROM (SELECT *, unnest(range(1, 65)) AS p FROM raw)
), bg AS (
  SELECT sequence, y, x, avg(v) AS b FROM px GROUP BY ALL
), r AS (
  SELECT sequence, frame, y, x, v - b AS r, avg(v - b) OVER (PARTITION BY sequence, frame) AS m FROM px JOIN bg USING (sequence, y, x)
), per AS (
  SELECT sequence, frame, avg(r) AS m, stddev_pop(r) AS s FROM r GROUP BY ALL
), st AS (
  SELECT sequence, count(*)::DOUBLE AS n, avg(m) - 5 * avg(s) AS alpha, 255 / (10 * avg(s)) AS beta FROM per GROUP BY ALL
), lo AS (
  SELECT sequence, min(b) AS minimum, avg(b) AS average FROM bg GROUP BY ALL
)
SELECT 'background' AS kind, sequence, NULL::BIGINT AS frame, y::INT AS y, x::INT AS x, round(b, 4) AS v FROM bg
UNION ALL SELECT 'image', sequence, frame, y, x, round(least(255.0, greatest(0.0, (r - m - alpha) * beta)), 4) FROM r JOIN st USING (sequence)
UNION ALL SELECT k.kind, sequence, NULL, NULL, NULL, round(k.v, 4)
FROM (SELECT sequence, unnest([{'kind': 'n', 'v': n}, {'kind': 'alpha', 'v': alpha}, {'kind': 'beta', 'v': beta}, {'kind': 'minimum', 'v': minimum}, {'kind': 'average', 'v': average}]) AS k FROM st JOIN lo USING (sequence))
"""


def job2_sequence_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of numbers in the paths of pages."""
    folder = new_path(spark, "job2")
    for _ in range(2):
        # a pattern, as a stream takes a single file only by one
        sequence_index.run(spark, f"{sf_dir}/pages.parque[t]", f"{folder}/index", f"{folder}/checkpoint")
    return sequence_index.read_output(spark, f"{folder}/index").select("pattern", "first", "last", "n")


JOB2 = r"""
WITH m AS (
  SELECT DISTINCT regexp_extract(url, '(?s)^(.*?)(\d+)(\D*)$', 1) || '#' || regexp_extract(url, '(?s)^(.*?)(\d+)(\D*)$', 3) AS pattern,
         TRY_CAST(regexp_extract(url, '(?s)^(.*?)(\d+)(\D*)$', 2) AS BIGINT) AS number
  FROM pages
), g AS (
  SELECT *, number - row_number() OVER (PARTITION BY pattern ORDER BY number) AS g FROM m WHERE number IS NOT NULL
)
SELECT pattern, min(number) AS first, max(number) AS last, count(*)::BIGINT AS n FROM g GROUP BY pattern, g
"""

QUERIES = {"job1_enhance_images": job1_enhance_images, "job2_sequence_index": job2_sequence_index}
ORACLES = {"job1_enhance_images": JOB1, "job2_sequence_index": JOB2}
