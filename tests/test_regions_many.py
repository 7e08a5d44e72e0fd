"""Many small files: as many tasks as shuffles have, not one for every few files, and regions that are sent together."""

import numpy as np
from pyspark.sql import functions as F
from voxtide.sources import images, regions


def test_tasks_do_not_grow_with_files(spark, tmp_path):
    rng = np.random.default_rng(4)
    a = rng.integers(0, 255, (200, 6, 7)).astype(np.uint8)
    for i, image in enumerate(a):
        (tmp_path / f"f{i:03d}.{'png' if i % 9 == 0 else 'tif'}").write_bytes(images.png(image) if i % 9 == 0 else images.tiff(image))
    points = spark.createDataFrame([(i, k, 2.0 + k, 3.0) for i in range(200) for k in range(3)], "frame long, part long, x double, y double")
    points.write.parquet(f"{tmp_path}/points")
    points = spark.read.parquet(f"{tmp_path}/points")  # few bytes, so it is the files that aren't moved
    found = regions.read_regions(spark, f"{tmp_path}/f*", points, 4)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition 4, false" in plan and "MapInArrow" in plan
    got = found.withColumn("task", F.spark_partition_id()).collect()
    assert {(r["frame"], r["part"]): r["px"] for r in got} == {(i, k): regions.cut_out(a[i].astype(float), k, 1, 4).ravel().tolist() for i in range(200) for k in range(3)}
    assert len({r["task"] for r in got}) <= 4 and len(got) == 600
