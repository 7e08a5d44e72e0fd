"""Written intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where that is unset, a temporary folder in local mode, else one in the cluster's default file system."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            _own_dirs[app] = tempfile.mkdtemp(prefix="voxtide-")
            atexit.register(shutil.rmtree, _own_dirs[app], ignore_errors=True)
        else:
            _own_dirs[app] = f"voxtide-checkpoints/{app}"
    return _own_dirs[app]


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/voxtide/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write `df` there and read it back: lineage is cut, and lost executors don't matter."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def qualified(spark: SparkSession, path: str) -> str:
    """`path` with its scheme: one without is in the default file system of the cluster, not of the machine."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where the driver found it."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in parts:
        env["PYTHONPATH"] = os.pathsep.join([root, *parts])


def clear(spark: SparkSession) -> None:
    """Remove every table that this application wrote; results that were not read yet are lost."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/voxtide/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
