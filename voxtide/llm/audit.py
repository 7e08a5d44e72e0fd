"""What each of several filters does in every order they may be applied in, by one product of small integer matrices.

A document's failed filters are the bits of a mask. For each part of the corpus (a language) the masks are counted
in a histogram: all documents, those labelled good, those labelled toxic. What a filter does at a step of an order
depends on the mask alone, so with the histograms stacked as rows, one product with an integer matrix of a row per mask
and a column per order and step gives the outcome of every order at once: kept, removed, redundant and unique.

The filters are `FILTERS`, by letter; all but `E` look at one text. `E` fails where a smaller id has the same text. It
is told by the first id of each SHA-256 of a text, for which ids are combined in the tasks before the shuffle, and a
join on both hash and id, so that copies, however many, are dealt by their ids. A row repeated with its id is counted
once, with its number. Only the histograms (32 numbers of a part, three times) meet the matrices.

Defined cases: a null text is empty; null and empty languages are one part, named ''; rows with the same id and text
don't make each other fail `E`; a null id is neither smaller nor larger than any other and so never fails it, nor has a
label; a document is good (toxic) if any row of `labels` with its id says so; without documents there are no parts.
Other columns, whatever their names, aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let, materialize, ship

LETTERS = "ABCDE"
MASKS = 2 ** len(LETTERS)
ORDERS = ["".join(p) for p in permutations(LETTERS)]
STEPS = [(order, step) for order in ORDERS for step in range(1, len(LETTERS) + 1)]
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def text_mask(text: Column) -> Column:
    """The bits of the filters A to D that a text (not null) fails."""
    words = F.filter(F.split(text, SPACE), lambda x: x != "")
    length = F.length(text).cast("long")
    capitals = length - F.length(F.translate(text, CAPITALS, ""))
    few = lambda a: F.when(F.size(a) < 200, 1).otherwise(0) + F.when(100 * F.size(F.array_distinct(a)).cast("long") < 50 * F.size(a).cast("long"), 2).otherwise(0)
    return let(words, few) + F.when(100 * capitals > 3 * length, 4).otherwise(0) + F.when(text.rlike(r"[#$%&*|]"), 8).otherwise(0)


def outcome_matrices() -> dict[str, np.ndarray]:
    """Of each outcome, 1 where a document with the mask of the row has it at the order and step of the column."""
    mask = np.arange(MASKS)[:, None]
    bits = np.array([[LETTERS.index(x) for x in order] for order in ORDERS])
    own = (1 << bits).reshape(1, -1)
    before = np.concatenate([np.zeros((len(bits), 1), int), np.bitwise_or.accumulate(1 << bits, axis=1)[:, :-1]], axis=1).reshape(1, -1)
    fails, gone = (mask & own) != 0, (mask & before) != 0
    made = {"kept": ~fails & ~gone, "removed": fails & ~gone, "redundant": fails & gone, "unique_fails": np.broadcast_to(mask == own, fails.shape)}
    return {name: m.astype(np.int64) for name, m in made.items()}


def failed_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, good, toxic, mask, n): how many documents of a part fail just the filters of a mask."""
    text = F.coalesce(F.col("text"), F.lit(""))
    row = [F.col("doc_id"), F.coalesce(F.col("lang"), F.lit("")).alias("part"), F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)).alias("h"), text_mask(text).alias("alone")]
    rows = docs.select(*row).groupBy("doc_id", "part", "h", "alone").agg(F.count(F.lit(1)).alias("n"))
    said = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marked = rows.join(said, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})
    table = materialize(marked, "audit-rows")
    first = table.groupBy("h").agg(F.min("doc_id").alias("doc_id")).filter("doc_id is not null").withColumn("first", F.lit(True))
    copy = F.when(F.col("first").isNull() & F.col("doc_id").isNotNull(), 16).otherwise(0)
    masked = table.join(first, ["h", "doc_id"], "left").withColumn("mask", F.col("alone") + copy)
    return masked.groupBy("part", "good", "toxic", "mask").agg(F.sum("n").alias("n"))


def histograms(masks: DataFrame) -> DataFrame:
    """(part, every, good, toxic): of each part the three histograms as arrays of a number per mask."""

    def counts(mark: Column) -> Column:
        one = lambda m: F.coalesce(F.sum(F.when(mark & (F.col("mask") == m), F.col("n"))), F.lit(0).cast("long"))
        return F.array(*[one(m) for m in range(MASKS)])

    return masks.groupBy("part").agg(counts(F.lit(True)).alias("every"), counts(F.col("good") == 1).alias("good"), counts(F.col("toxic") == 1).alias("toxic"))


def outcomes(stacked: DataFrame) -> DataFrame:
    """The rows of the audit: histograms of many parts stacked, times the matrices."""
    ship(stacked.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = outcome_matrices()
        letter = np.array([LETTERS.index(order[step - 1]) for order, step in STEPS])
        same = [np.flatnonzero(letter == i) for i in range(len(LETTERS))]
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                n = batch.num_rows
                rows = {c: np.array(batch.column(i + 1).to_pylist(), np.int64).reshape(n, MASKS) for i, c in enumerate(("every", "good", "toxic"))}
                made = {name: rows["every"] @ m for name, m in matrix.items()}
                made |= {"good_lost": rows["good"] @ matrix["removed"], "toxic_lost": rows["toxic"] @ matrix["removed"]}
                share = np.stack([made["removed"][:, where].sum(1) for where in same], axis=1)
                made["shapley"] = share[:, letter]
                parts = batch.column(0).to_pylist()
                columns = [pa.array(np.repeat(np.array(parts, object), len(STEPS)), pa.string()), pa.array([o for o, _ in STEPS] * n), pa.array(np.tile(np.array([s for _, s in STEPS], np.int32), n))]
                names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(made[c].ravel()) for c in names], ["part", "filter_order", "step", *names])

    return stacked.mapInArrow(run, SCHEMA)


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per part, order of the filters and step: documents kept after it, removed by it, failing it but gone before, failing it alone, good and toxic ones removed, and what its filter removes summed over all orders."""
    return outcomes(histograms(failed_masks(docs, labels)))
