"""What the operators share: word patterns, checked broadcasts and expression helpers."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import materialize, new_path, ship  # noqa: F401

#: A word is a run of characters other than space and the controls 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of a table of fixed-width columns that may be broadcast; beyond it the joins shuffle.
BROADCAST_ROWS = 500_000

def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of finished steps whose tables are written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` (a written table of narrow rows) marked for broadcast if it was counted to have at most `rows` rows."""
    return F.broadcast(df) if df.count() <= rows else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once, however often a lambda in `body` refers to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def least_row(columns: list[str]) -> Column:
    """Of the rows of a group, as a struct, the one whose JSON form is least; rows alike in that are alike."""
    row = F.struct(*[F.col(f"`{c}`") for c in columns])
    return F.min_by(row, F.to_json(row, {"ignoreNullFields": "false"}))


def sample_cut(want: float, have: int) -> int:
    """The 64-bit hash up to which a sample of some `want` of `have` rows is taken; every hash if there are no more."""
    return 2**63 - 1 if want >= have else -(2**63) + int(want * 2**64) // have
