"""Numbered files as runs of consecutive numbers, which merge in any order and any number of times.

A path is a pattern, its last run of digits left out, and a number. Of each pattern, numbers are kept as runs that
don't leave a cell of `CELL` numbers, so merging new numbers into old runs is a window over one cell of one pattern,
bounded whatever the length of a sequence, and a sequence with a third of all files is spread over its cells. What is
merged twice changes nothing. Runs that touch the border of their cell are joined at the end, two a cell at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CELL = 65_536
_PATH = r"(?s)^(.*?)(\d+)(\D*)$"


def numbered(paths: DataFrame, column: str, *keep: str) -> DataFrame:
    """(keep, pattern, number): the pattern has # where the number was. Paths without a number, or with one beyond 64 bits, and null paths are left out."""
    part = lambda i: F.regexp_extract(column, _PATH, i)
    rows = paths.select(*keep, F.concat(part(1), F.lit("#"), part(3)).alias("pattern"), F.nullif(part(2), F.lit("")).try_cast("bigint").alias("number"))
    return rows.filter("number is not null")




def as_runs(numbers: DataFrame, *keys: str) -> DataFrame:
    """Distinct rows of (keys, number) as runs of one number (keys, cell, first, last)."""
    number = F.col("number")
    return numbers.select(*keys, "number").distinct().select(*keys, F.expr(f"number div {CELL}").alias("cell"), number.alias("first"), number.alias("last"))


def merged(runs: DataFrame, *keys: str) -> DataFrame:
    """(keys, cell, first, last): runs of a cell that overlap or follow each other are one."""
    at = Window.partitionBy(*keys, "cell").orderBy("first", "last")
    reach = F.max("last").over(at.rowsBetween(Window.unboundedPreceding, -1))
    marked = runs.withColumn("new", F.coalesce((F.col("first") > reach + 1).cast("int"), F.lit(1)))
    grouped = marked.withColumn("g", F.sum("new").over(at.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*keys, "cell", "g").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("g")


def joined(runs: DataFrame, *keys: str) -> DataFrame:
    """(keys, first, last, n) of merged runs: those that go on in the next cell are one."""
    low, high = F.col("cell") * CELL, F.col("cell") * CELL + (CELL - 1)
    edge = (F.col("first") == low) | (F.col("last") == high)
    inner = runs.filter(~edge).select(*keys, "first", "last")
    order = Window.partitionBy(*keys).orderBy("first")
    chain = runs.filter(edge).withColumn("new", F.coalesce((F.col("first") != F.lag("last").over(order) + 1).cast("int"), F.lit(1)))
    chain = chain.withColumn("g", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = chain.groupBy(*keys, "g").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("g")
    return inner.unionByName(whole).withColumn("n", F.col("last") - F.col("first") + 1)
