"""Mixing sources to target weights by blocks, with multinomial counts per output shard.

The words of a source form one stream (its documents in a pseudorandom order) that is cut into blocks of a fixed
length. The output is a list of slots, dealt over shards of equal size. How many slots of a shard each source fills is
a multinomial draw; the draws are conditioned on the totals that meet the targets, by splitting the range of shards in
halves again and again, each split with its own seed, so any task can draw any shard alone and reruns agree. The j-th
slot of a source takes the block that a keyed permutation of its block numbers (one per pass over the source) gives
for j. Slots and blocks are then joined by source and block number.

Only one row per source is on the driver, where the weights and targets are computed; a mixture that lists more than
`MAX_SOURCES` sources is refused. Everything else is distributed: the stream offsets come from sums over hash ranges
of each source, so a source with a third of all rows is many ranges.

Defined cases: null texts have size 0 and are never taken; a null source is a source of its own and sorts last; rows
that repeat an id are separate documents; sources without words have target 0; an empty table gives no rows. Columns
of the input other than the named ones are never looked at by `mix_report` and pass through `mixed_documents`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, materialize, n_words, partitions, ship

MAX_SOURCES = 1_000_000
#: Words of a block; slots of a shard; rows of a hash range of a source.
BLOCK_WORDS, SHARD_SLOTS, RANGE_ROWS = 64, 4096, 2000
#: Populations from this size on are beyond NumPy's hypergeometric generator and drawn by inverting the distribution.
LARGE = 900_000_000
#: Ranges of a source whose sums are added up in one task.
RANGES_TOGETHER = 1024


@dataclass(frozen=True)
class Source:
    name: str | None
    size: int
    weight: float
    target: float
    blocks: int
    slots: int


def targets(sizes: list[int], weights: list[float], share: float = 1.0, most: float = 3.0) -> list[float]:
    """`share` of all sizes by weight; a source stops at `most` times its size and the excess goes to the others by weight."""
    goal, open_, out = share * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    left = goal
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in over)
        open_ -= set(over)
    return out


def plan_sources(per_source: list[tuple[str | None, int]], block_words: int = BLOCK_WORDS, share: float = 1.0, most: float = 3.0) -> list[Source]:
    """Sources by code point, null last, weigh 1, 2, 3, 1, 2, 3, ..."""
    if len(per_source) > MAX_SOURCES:
        raise ValueError(f"a mixture of {len(per_source)} sources; at most {MAX_SOURCES} can be planned")
    rows = sorted(per_source, key=lambda x: (x[0] is None, x[0] or ""))
    weights = [float(i % 3 + 1) for i in range(len(rows))]
    goals = targets([n for _, n in rows], weights, share, most)
    out = []
    for (name, n), w, goal in zip(rows, weights, goals, strict=True):
        blocks = -(-n // block_words)
        slots = min(round(goal * blocks / n), int(most * blocks)) if n else 0
        out.append(Source(name, n, w, goal, blocks, slots))
    return out


def hypergeometric(good: int, bad: int, n: int, rng: np.random.Generator) -> int:
    """How many of `n` draws without replacement are good, for populations of any size.

    Beyond NumPy's limit the distribution is summed up over ten standard deviations around its mode and inverted.
    """
    if good + bad < LARGE:
        return int(rng.hypergeometric(good, bad, n))
    total = good + bad
    mode = (n + 1) * (good + 1) // (total + 2)
    wide = int(10 * (n * (good / total) * (bad / total) * ((total - n) / total)) ** 0.5) + 10
    lo, hi = max(0, n - bad, mode - wide), min(n, good, mode + wide)
    k = np.arange(lo, hi, dtype=np.float64)
    steps = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(float(bad - n) + k + 1)
    log_p = np.concatenate([[0.0], np.cumsum(steps)])
    upto = np.cumsum(np.exp(log_p - log_p.max()))
    return lo + int(np.searchsorted(upto, rng.random() * upto[-1]))


def split(totals: np.ndarray, n: int, seed: list[int]) -> np.ndarray:
    """How many of `n` draws without replacement fall to each kind."""
    rng, left, out = np.random.default_rng(seed), int(totals.sum()), np.zeros_like(totals)
    if left < LARGE:
        return rng.multivariate_hypergeometric(totals, n, method="marginals") if left else out
    for i, t in enumerate(totals.tolist()):
        left -= t
        out[i] = hypergeometric(t, left, n, rng) if n else 0
        n -= int(out[i])
    return out


def shard_counts(shard: int, slots: np.ndarray, seed: int, shard_slots: int = SHARD_SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """Of one output shard: the slots that each source fills, and those that it fills in all shards before."""
    before, now = np.zeros_like(slots), slots.copy()
    lo, hi = 0, max(1, -(-int(slots.sum()) // shard_slots))
    while hi - lo > 1:
        mid = (lo + hi) // 2
        first = split(now, (mid - lo) * shard_slots, [seed, lo, hi])
        if shard < mid:
            hi, now = mid, first
        else:
            lo, before, now = mid, before + first, now - first
    return now, before


def permuted(j: np.ndarray, n: int, keys: np.ndarray) -> np.ndarray:
    """A keyed permutation of 0..n-1 at j: four Feistel rounds over the next even number of bits, walked until in range."""
    half = max(1, (max(1, (n - 1).bit_length()) + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    x, todo = j.astype(np.uint64), np.ones(len(j), bool)
    while todo.any():
        left, right = x[todo] >> np.uint64(half), x[todo] & mask
        for k in keys.T:
            f = (right + k[todo]) * np.uint64(0x9E3779B97F4A7C15)
            f ^= f >> np.uint64(32)
            f *= np.uint64(0xD6E8FEB86659FD93)
            left, right = right, left ^ ((f >> np.uint64(29)) & mask)
        x[todo] = (left << np.uint64(half)) | right
        todo = x >= n
    return x.astype(np.int64)


def slot_blocks(source: int, blocks: int, first: int, count: int, seed: int) -> np.ndarray:
    """The blocks that slots first..first+count-1 of a source take."""
    j = first + np.arange(count, dtype=np.int64)
    turn = j // blocks
    keys = np.zeros((count, 4), np.uint64)
    for t in np.unique(turn):
        keys[turn == t] = np.random.default_rng([seed, source, int(t)]).integers(0, 2**63, 4, dtype=np.uint64)
    return permuted(j % blocks, blocks, keys)


def slots_table(spark, plan: list[Source], seed: int = 0, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(shard, slot, rank, pass, block): what fills every slot of the output."""
    ship(spark)
    slots, blocks = np.array([s.slots for s in plan], np.int64), [s.blocks for s in plan]
    shards = -(-int(slots.sum()) // shard_slots)

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["id"].tolist():
                now, before = shard_counts(shard, slots, seed, shard_slots)
                rank = np.repeat(np.arange(len(slots)), now)
                of = [(int(b), int(n), slot_blocks(r, blocks[r], int(b), int(n), seed)) for r, (b, n) in enumerate(zip(before, now, strict=True)) if n]
                block = np.concatenate([x for *_, x in of]) if of else np.zeros(0, np.int64)
                turn = np.concatenate([(b + np.arange(n)) // blocks[r] for (b, n, _), r in zip(of, np.flatnonzero(now), strict=True)]) if of else block
                order = np.random.default_rng([seed, 1 << 40, shard]).permutation(len(rank))
                yield pd.DataFrame({"shard": shard, "slot": order, "rank": rank, "pass": turn, "block": block})

    parts = max(1, min(shards, 4 * partitions(spark)))
    return spark.range(0, shards, 1, parts).mapInPandas(fill, "shard long, slot long, rank long, pass long, block long")


def tie_of(id_col: str, text_col: str) -> Column:
    """128 bits that tell documents with words apart: two hashes, over id and text in either order."""
    return F.struct(F.xxhash64(F.col(id_col), F.col(text_col)).alias("a"), F.xxhash64(F.col(text_col), F.col(id_col), F.lit(1)).alias("b"))


def _ranked(rows: DataFrame, plan: list[Source]) -> DataFrame:
    """`rows` with `rank` for `source`; the plan has at most MAX_SOURCES rows, so it can be broadcast."""
    of = rows.sparkSession.createDataFrame([(s.name, i) for i, s in enumerate(plan)], "__name string, rank long")
    return rows.join(F.broadcast(of), rows["source"].eqNullSafe(F.col("__name"))).drop("__name", "source")


def stream(sized: DataFrame, seed: int = 0, range_rows: int = RANGE_ROWS) -> DataFrame:
    """`sized` (rank, size, tie) with `start`, the words of its source before it."""
    ranges = max(1, -(-sized.count() // range_rows))
    keyed = sized.withColumn("r", F.xxhash64("tie", F.lit(seed))).withColumn("part", F.pmod(F.col("r"), F.lit(ranges)))
    sums = keyed.groupBy("rank", "part").agg(F.sum("size").alias("all"))
    # sums over many ranges first, so that no task adds up all ranges of a source
    sums = materialize(sums.withColumn("run", F.expr(f"part div {RANGES_TOGETHER}")), "mix-sums")
    runs = sums.groupBy("rank", "run").agg(F.sum("all").alias("whole"))
    runs = runs.select("rank", "run", (F.sum("whole").over(Window.partitionBy("rank").orderBy("run")) - F.col("whole")).alias("base"))
    within = F.sum("all").over(Window.partitionBy("rank", "run").orderBy("part")) - F.col("all")
    sums = sums.withColumn("within", within).join(runs, ["rank", "run"])
    sums = materialize(sums.select("rank", "part", (F.col("base") + F.col("within")).alias("before")), "mix-ranges")
    own = Window.partitionBy("rank", "part").orderBy("r", "tie")
    placed = keyed.withColumn("upto", F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, -1)))
    return placed.join(sums, ["rank", "part"]).withColumn("start", F.col("before") + F.coalesce("upto", F.lit(0))).drop("r", "part", "upto", "before")


def block_rows(streamed: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row for each block that a document reaches into: `block`, and `lo` and `hi`, the words of the document there."""
    end = F.col("start") + F.col("size")
    first, last = F.expr(f"start div {block_words}"), F.expr(f"(start + size - 1) div {block_words}")
    each = streamed.filter("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    lo = F.greatest(F.col("block") * block_words, F.col("start")) - F.col("start")
    hi = F.least((F.col("block") + 1) * block_words, end) - F.col("start")
    return each.withColumns({"lo": lo, "hi": hi})


def _plan(sized: DataFrame, block_words: int) -> list[Source]:
    rows = sized.groupBy("source").agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    return plan_sources([(r["source"], r["size"]) for r in rows], block_words)


def mix_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS, seed: int = 0) -> DataFrame:
    """Per document: id, size, source_size, target (of its source) and taken (words the mix takes of it, repeats counted)."""
    spark = docs.sparkSession
    tie = tie_of(id_col, text_col)
    sized = materialize(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"), tie.alias("tie")), "mix-sizes")
    plan = _plan(sized, block_words)
    streamed = materialize(stream(_ranked(sized, plan), seed), "mix-stream")
    # the planner can't tell how many slots there are, and must not broadcast them
    taken = slots_table(spark, plan, seed).groupBy("rank", "block").agg(F.count(F.lit(1)).alias("times")).hint("merge")
    # start and rank tell documents with words apart
    per_doc = block_rows(streamed, block_words).join(taken, ["rank", "block"]).groupBy("rank", "start").agg(F.sum(F.col("times") * (F.col("hi") - F.col("lo"))).alias("taken"))
    with_words = streamed.filter("size > 0").join(per_doc, ["rank", "start"], "left").select("id", "size", "rank", "taken")
    rows = with_words.unionByName(streamed.filter("size = 0").select("id", "size", "rank", F.lit(0).cast("long").alias("taken")))
    of = spark.createDataFrame([(i, s.size, s.target) for i, s in enumerate(plan)], "rank long, source_size long, target double")
    return rows.join(F.broadcast(of), "rank").select(F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str | None = "n_chars", block_words: int = BLOCK_WORDS, seed: int = 0) -> DataFrame:
    """The mix as rows of `docs`: for each pass over a source, each run of words taken of a document is a row.

    A document taken whole keeps its text as it is; a part keeps the text from its first word to its last.
    """
    spark = docs.sparkSession
    ship(spark)
    cols = docs.columns
    tie = tie_of(id_col, text_col)
    sized = materialize(docs.select(F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"), tie.alias("tie")), "mix-sizes")
    plan = _plan(sized, block_words)
    # rows that agree in id and text are one document, repeated: each of them gets a place of its own in the stream
    streamed = materialize(stream(_ranked(sized, plan), seed), "mix-stream")
    nth = Window.partitionBy("rank", "tie").orderBy("start")
    hits = block_rows(streamed.withColumn("nth", F.row_number().over(nth)), block_words).join(slots_table(spark, plan, seed).select("rank", "block", "pass").hint("merge"), ["rank", "block"])
    by_pass = hits.groupBy("rank", "tie", "nth", "size", "pass").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("spans"))
    # a run begins where a span doesn't go on from the one before it, and ends where none goes on
    begins = F.filter("spans", lambda x, i: F.coalesce(F.get("spans", i - 1)["hi"] != x["lo"], F.lit(True)))
    ends = F.filter("spans", lambda x, i: F.coalesce(F.get("spans", i + 1)["lo"] != x["hi"], F.lit(True)))
    joined = F.zip_with(begins, ends, lambda x, y: F.struct(x["lo"].alias("lo"), y["hi"].alias("hi")))
    runs = by_pass.select("rank", "tie", "nth", joined.alias("runs")).groupBy("rank", "tie", "nth").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    runs = materialize(runs, "mix-runs")
    own = _ranked(docs.select(F.struct(*[docs[c] for c in cols]).alias("row"), tie.alias("tie"), F.col(source_col).cast("string").alias("source")), plan)
    repeated = streamed.groupBy("rank", "tie").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if repeated.isEmpty():
        own = own.withColumn("nth", F.lit(1))
    else:
        own = own.withColumn("nth", F.row_number().over(Window.partitionBy("rank", "tie").orderBy(F.lit(1))))
    found = own.join(runs, ["rank", "tie", "nth"]).select("row", "runs")
    found = found.withColumn("parts", parts_of(F.col("row")[text_col], F.col("runs"))).select("row", F.explode("parts").alias("part"))
    out = found.select(*[F.col("row")[c].alias(c) for c in cols if c not in (text_col, chars_col)], F.col("part").alias(text_col))
    if chars_col in cols:
        out = out.withColumn(chars_col, F.length(text_col).cast(docs.schema[chars_col].dataType))
    return out.select(*cols)


def _cut(text: pd.Series, runs: pd.Series) -> pd.Series:
    out = []
    for t, parts in zip(text, runs, strict=True):
        if t is None:
            out.append(None)
            continue
        # the words at the ends of runs, found in one pass
        wanted = {k for r in parts for k in (r["lo"], r["hi"] - 1)}
        at, last = {}, max(wanted)
        for k, m in enumerate(re.finditer(WORD, t)):
            if k in wanted:
                at[k] = m.span()
            if k == last:
                break
        out.append([t[at[r["lo"]][0] : at[r["hi"] - 1][1]] for r in parts])
    return pd.Series(out, dtype=object)


def parts_of(text: Column, runs: Column) -> Column:
    """Of each run, words lo to hi-1 of a text with what stands between them; the whole text, as it is, for all words."""
    n = n_words(text)
    whole = F.forall(runs, lambda r: (r["lo"] == 0) & (r["hi"] == n))
    # not to be copied into the filter that the optimizer infers from an explode: texts would be cut twice
    cut = F.pandas_udf(_cut, "array<string>").asNondeterministic()(F.when(~whole, text), F.when(~whole, runs))
    of = F.zip_with(runs, cut, lambda r, x: F.when((r["lo"] == 0) & (r["hi"] == n), text).otherwise(x))
    return F.when(whole, F.transform(runs, lambda r: text)).otherwise(of)
