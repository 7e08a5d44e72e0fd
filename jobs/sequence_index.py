"""An index of numbered files: which numbers of each sequence are there, kept up to date as lists of paths arrive.

    python jobs/sequence_index.py --paths PATH --output PATH --checkpoint PATH [--config PATH]

Reads Parquet files with a column of paths as a stream that takes only files it hasn't taken before, and writes,
partitioned by bucket (a hash of the pattern),

    OUTPUT/runs    pattern, first, last, n: consecutive numbers that are there; what lies between two runs is missing
    OUTPUT/cells   the same in cells of 65,536 numbers, which later runs of the job merge into

The checkpoint holds which files were taken. A batch reads the buckets its patterns are in, merges, and replaces these
buckets by dynamic partition overwrite. A batch that was cut off is taken again whole; numbers that are merged twice
change nothing, so the index comes out the same. It doesn't matter in which order or how often paths arrive.

Null paths, and paths without a number of 64 bits, aren't indexed and are counted in the log. Without new files nothing
is written.
"""

from __future__ import annotations

import argparse
import logging
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from voxtide.operators import runs
from voxtide.sources import files
from voxtide.tables import materialize

log = logging.getLogger("voxtide.jobs.sequence_index")
DEFAULTS = {"column": "url", "buckets": "32", "files_per_batch": "1000"}
CELLS = "pattern string, cell long, first long, last long, bucket int"
RUNS = "pattern string, first long, last long, n long, bucket int"


def config_of(spark: SparkSession, path: str | None) -> dict[str, str]:
    """The defaults with what a file of key = value lines says."""
    said = {r["key"]: r["value"] for r in files.read_pairs(spark, path).collect()} if path else {}
    if unknown := said.keys() - DEFAULTS.keys():
        raise ValueError(f"no such setting: {', '.join(sorted(unknown))}")
    return DEFAULTS | said


def replaced(rows: DataFrame, path: str) -> None:
    """The buckets that `rows` has, and no others, are replaced."""
    rows.write.partitionBy("bucket").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def merge(batch: DataFrame, output: str, column: str, buckets: int) -> dict[str, int]:
    """Merge a batch of paths into the index; gives how many paths there were and how many were indexed."""
    spark = batch.sparkSession
    numbers = runs.numbered(batch, column)
    bucket = F.pmod(F.xxhash64("pattern"), F.lit(buckets)).cast("int")
    fresh = materialize(runs.merged(runs.as_runs(numbers.withColumn("bucket", bucket), "bucket", "pattern"), "bucket", "pattern"), "index-fresh")
    touched = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]  # no more than `buckets`
    counts = {"paths": batch.count(), "indexed": numbers.count(), "buckets": len(touched)}
    if touched:
        old = spark.read.schema(CELLS).parquet(f"{output}/cells").filter(F.col("bucket").isin(touched))
        cells = materialize(runs.merged(old.unionByName(fresh), "bucket", "pattern"), "index-cells")
        replaced(cells, f"{output}/cells")
        replaced(runs.joined(cells, "bucket", "pattern"), f"{output}/runs")
    return counts


def run(spark: SparkSession, paths: str, output: str, checkpoint: str, config: str | None = None) -> list[dict[str, int]]:
    """Take what is new; gives the counts of each batch."""
    settings = config_of(spark, config)
    column, buckets = settings["column"], int(settings["buckets"])
    for part, schema in (("cells", CELLS), ("runs", RUNS)):
        # adds no row: only sees to it that the folder is there to be read
        spark.createDataFrame([], schema).write.partitionBy("bucket").mode("append").parquet(f"{output}/{part}")
    done: list[dict[str, int]] = []

    def take(batch: DataFrame, number: int) -> None:
        counts = merge(batch, output, column, buckets)
        log.info("batch %d: %d paths read from %s, %d indexed, %d buckets written", number, counts["paths"], paths, counts["indexed"], counts["buckets"])
        done.append(counts)

    stream = spark.readStream.schema(f"`{column}` string").option("maxFilesPerTrigger", int(settings["files_per_batch"])).parquet(paths)
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("%s: %d batches, %d new paths", output, len(done), sum(c["paths"] for c in done))
    return done


def read_output(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(RUNS).parquet(f"{output}/runs")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    p.add_argument("--paths", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--checkpoint", required=True)
    p.add_argument("--config")
    a = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("sequence_index").getOrCreate()
    try:
        run(spark, a.paths, a.output, a.checkpoint, a.config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
