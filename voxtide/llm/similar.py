"""SimHash near-deduplication by similarity: fingerprints of samples of a text's shingles.

Two texts are linked if the sets of their shingles (`SHINGLE_WORDS` words each) have a similarity of `SIMILARITY` or
more. The fingerprint of a whole text doesn't find these: at a similarity of 0.8 it lies 8 to 14 of 64 bits away, where
tables of distances have to compare a share of all pairs. So a text gets `SAMPLES` fingerprints, each of a sample of
`SAMPLE` shingles: those with the least hashes under as many random maps, the same ones in similar texts. A bit is 1 if
set in over half of a sample's hashes. Candidates have, for one of the samples, equal distances to the reference
fingerprints of `simhash` within its segments; pairs whose greatest coordinate difference over all bits exceeds `RADIUS`
are discarded, the fingerprints of the rest are compared bit by bit, and of each pair that is left the similarity is
computed exactly from both sets. A pair at similarity s shares no sample
with a probability of (1 - s ** SAMPLE) ** SAMPLES, at 0.8 that is 3 in 100,000; all else is whole.

A group of texts that agree in a sample is compared pairwise only up to `PAIRWISE`. In a larger one each text is first
compared with three of the group, among them the one that shares most samples with others (of copies of a text, that
text). Where this leaves a group in several components, its texts are searched by an exact join of prefixes: shingles
are put in one order, those of the fewest texts first; a text's place in the order then bounds what it can share
with another from there on, and with it the sizes of texts that it may be similar to. Texts meet in a shingle of the
first fifth and a class of sizes that both allow, and only across components. So a large group makes rows in proportion
to its size, unless its texts are similar and apart, and no link is lost.

Defined cases: case and blanks are those of `simhash.fingerprint`; a null or empty text has one empty shingle, so such
texts are alike; a text of fewer words than a shingle is one shingle. Equal texts are one node, by a 128-bit hash. Of rows that agree in
id and text the one whose JSON form is least stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .common import broadcast_if_small, least_row, materialize, ship
from .simhash import BITS, distance, references, segment_distances, segments

SHINGLE_WORDS, SIMILARITY, SEED = 5, 0.8, 42
SAMPLE, SAMPLES, PAIRWISE = 4, 20, 32
#: Bits by which fingerprints of a sample may differ.
RADIUS = 0


def shingles(text: bytes, words: int = SHINGLE_WORDS) -> np.ndarray:
    """The different shingles of a text in UTF-8, as sorted 64-bit hashes."""
    from xxhash import xxh64_intdigest

    found = text.lower().split()  # of bytes: A-Z and the six ASCII blanks only
    line, k = b" ".join(found), min(words, len(found))
    if not found:
        return np.array([xxh64_intdigest(b"", SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    start, stop = np.concatenate([[0], ends])[: len(found) - k + 1].tolist(), (ends[k - 1 :] - 1).tolist()
    return np.unique(np.fromiter((xxh64_intdigest(line[a:b], SEED) for a, b in zip(start, stop, strict=True)), np.uint64, len(start)))


def sample_fingerprints(hashes: np.ndarray) -> np.ndarray:
    """A fingerprint per sample: the majority, bit by bit, of the least of `SAMPLE` random linear maps of the hashes."""
    draw = np.random.default_rng(11)
    times, plus = draw.integers(0, 2**64, (2, SAMPLE * SAMPLES, 1), np.uint64)
    least = np.full(SAMPLE * SAMPLES, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 1024):
        least = np.minimum(least, (hashes[at : at + 1024] * (times | np.uint64(1)) + plus).min(1))
    bits = np.unpackbits(least.view(np.uint8), bitorder="little").reshape(SAMPLES, SAMPLE, BITS)
    return np.packbits(2 * bits.sum(1, dtype=np.uint8) > SAMPLE, axis=1, bitorder="little").view(np.int64).ravel()


def pivoted(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """`rows` (fp) with their distances to the references within each segment, and the names of these columns."""
    near = {f"near{i}": segment_distances(F.col("fp"), bits) for i, bits in enumerate(segments(RADIUS))}
    return rows.withColumns(near), list(near)


def agreeing(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs of fingerprints (columns a and b) whose greatest coordinate difference doesn't exceed the radius, verified bit by bit."""
    far = F.greatest(*[F.abs(distance(F.col(a), F.lit(r)) - distance(F.col(b), F.lit(r))) for r in references()])
    return pairs.filter(far <= RADIUS).filter(distance(F.col(a), F.col(b)) <= RADIUS)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Few rows at a time, as the sets of a batch take more memory than its texts."""
    return (batch.slice(at, rows) for batch in batches for at in range(0, batch.num_rows, rows))


def signed(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """(id, x, n, fps) of (id, x, t): the number of different shingles and the fingerprint of each sample."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = [shingles(t.as_py() or b"", words) for t in batch.column(2)]
            fps = pa.array([sample_fingerprints(s) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), fps], ["id", "x", "n", "fps"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "x", F.col("t").cast("binary")).mapInArrow(run, f"id {kind}, x binary, n long, fps array<long>")


def shingle_sets(texts: DataFrame, wanted: DataFrame, words: int, tag: str) -> DataFrame:
    """(x, s) of the `wanted` (x) of `texts` (x, t): the hashes of their shingles, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = [shingles(t.as_py() or b"", words).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["x", "s"])

    sets = texts.join(broadcast_if_small(wanted), "x", "left_semi").select("x", F.col("t").cast("binary")).mapInArrow(run, "x binary, s array<long>")
    return materialize(sets.dropDuplicates(["x"]), tag)


def verified(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (src, dst) whose similarity, computed from both sets of shingles of `texts` (x, t), is high enough."""
    pairs = materialize(pairs.distinct(), "similar-pairs")
    ends = pairs.select(F.col("src").alias("x")).unionByName(pairs.select(F.col("dst").alias("x"))).distinct()
    sets = shingle_sets(texts, materialize(ends, "similar-ends"), words, "similar-sets")
    a, b = sets.select(F.col("x").alias("src"), F.col("s").alias("sa")), sets.select(F.col("x").alias("dst"), F.col("s").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    found = pairs.join(a, "src").join(b, "dst").withColumn("both", both)
    return materialize(found.filter(F.col("both") >= similarity * (F.size("sa") + F.size("sb") - F.col("both")) - 1e-9).select("src", "dst"), "similar-links")


def size_class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) * 50).cast("int")


def prefix_pairs(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs across components that can be similar: no other pair of `members` (x, c) is, whose `sets` (x, s) these are.

    At a similarity of t, a share of t / (1 + t) of both sizes is common, and t of either; so a common shingle is among
    the first (1 - t) of each in any order, and at place p of a text with n shingles the other has at most
    (1 + t) / t * (n - p) - n of them. The order is that of the number of texts with a shingle, so what an edit brought in
    comes before what all copies have; a shingle of one text only is common to none and isn't written.
    """
    each = sets.select("x", F.explode("s").alias("w"))
    counts = materialize(each.groupBy("w").agg(F.count(F.lit(1)).alias("k"), F.min("x").alias("x")), "similar-counts")
    lone = counts.filter("k = 1").groupBy("x").agg(F.collect_list("w").alias("lone"))
    shared = F.when(F.col("lone").isNull(), F.col("s")).otherwise(F.array_except("s", "lone"))
    rows = sets.join(lone, "x", "left").select("x", F.size("s").alias("n"), shared.alias("s"))
    first = F.floor((1 - similarity) * F.col("n") + 1e-9) + 1 - (F.col("n") - F.size("s"))
    rows = rows.join(members, "x").withColumns({"most": first.cast("int"), "before": F.col("n") - F.size("s")}).filter("most > 0")
    often = materialize(counts.filter("k > 1").select("w", "k"), "similar-often")
    ranked = rows.select("x", "c", "n", "most", "before", F.explode("s").alias("w")).join(broadcast_if_small(often), "w")
    ranked = ranked.groupBy("x", "c", "n", "most", "before").agg(F.array_sort(F.collect_list(F.struct("k", "w"))).alias("s"))
    rows = ranked.select("x", "c", "n", "before", F.posexplode(F.slice("s", 1, F.col("most"))).alias("i", "kw")).withColumn("w", F.col("kw.w"))
    upto = F.least((1 + similarity) / similarity * (F.col("n") - F.col("before") - F.col("i")) - F.col("n"), F.col("n") / similarity) + 1e-6
    rows = materialize(rows.withColumn("upto", upto).filter(F.col("upto") >= similarity * F.col("n")).select("x", "c", "n", "w", "upto"), "similar-prefixes")
    # of the texts with a shingle, those outside the component that has most of them are compared with all
    main = rows.groupBy("w", "c").agg(F.count(F.lit(1)).alias("k")).groupBy("w").agg(F.max_by("c", F.struct("k", "c")).alias("main"), F.count(F.lit(1)).alias("apart")).filter("apart > 1")
    main = materialize(main.select("w", "main"), "similar-main")
    rows = materialize(rows.join(broadcast_if_small(main), "w"), "similar-apart")
    a = rows.filter("c <> main").select("w", F.col("x").alias("xa"), F.col("n").alias("na"), F.col("c").alias("ca"), F.col("upto").alias("ua"))
    a = a.withColumn("size", F.explode(F.sequence(size_class(F.ceil(similarity * F.col("na") - 1e-6)), size_class(F.floor("ua")))))
    b = rows.select("w", F.col("x").alias("xb"), F.col("n").alias("nb"), F.col("c").alias("cb"), F.col("upto").alias("ub"), size_class(F.col("n")).alias("size"))
    fits = (F.col("nb") <= F.col("ua")) & (F.col("na") <= F.col("ub")) & (F.col("ca") != F.col("cb"))
    return a.join(b, ["w", "size"]).filter(fits).select(F.least("xa", "xb").alias("src"), F.greatest("xa", "xb").alias("dst"))


def links(nodes: DataFrame, texts: DataFrame, words: int = SHINGLE_WORDS, similarity: float = SIMILARITY, pairwise: int = PAIRWISE) -> DataFrame:
    """(src, dst): links between nodes (x, n, fps); those that reach each other are those within chains of similar texts."""
    rows, near = pivoted(nodes.select("x", "n", F.posexplode("fps").alias("sample", "fp")))
    on, end = ["sample", *near], F.struct("x", "fp")
    sizes = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("many"), F.min(end).alias("lo"), F.max(end).alias("hi")).filter("many > 1")
    sizes = materialize(sizes, "similar-groups")
    grouped = materialize(rows.join(broadcast_if_small(sizes), on), "similar-candidates")
    close = lambda a, b: F.least(a, b) >= similarity * F.greatest(a, b) - 1e-9
    few, large = grouped.filter(F.col("many") <= pairwise), grouped.filter(F.col("many") > pairwise)
    a, b = (few.select(*on, F.col("x").alias(x), F.col("n").alias(f"n{k}"), F.col("fp").alias(f"f{k}")) for x, k in (("src", "a"), ("dst", "b")))
    met = agreeing(a.join(b, on).filter("src < dst"), "fa", "fb")
    pairs = met.filter(close(F.col("na"), F.col("nb"))).select("src", "dst")
    if large.isEmpty():
        return verified(pairs, texts, words, similarity)
    weight = large.groupBy("x").agg(F.sum("many").alias("weight"))
    weighed = materialize(large.join(weight, "x"), "similar-large")
    best = weighed.groupBy(*on).agg(F.max_by(end, F.struct("weight", "x")).alias("best"))
    best = broadcast_if_small(materialize(best, "similar-centres"))
    star = weighed.join(best, on).select("x", "fp", F.explode(F.array("lo", "hi", "best")).alias("to")).select(F.col("x").alias("dst"), "fp", F.col("to.x").alias("src"), F.col("to.fp").alias("fc"))
    star = agreeing(star.filter("src <> dst"), "fp", "fc").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    first = verified(pairs.unionByName(star), texts, words, similarity)
    parts = connected_components(first)
    placed = materialize(large.join(parts, large["x"] == parts["node"], "left").select(*on, "x", F.coalesce("component", "x").alias("c")), "similar-placed")
    apart = placed.groupBy(*on).agg(F.min("c").alias("a"), F.max("c").alias("b")).filter("a <> b").select(*on)
    members = materialize(placed.join(broadcast_if_small(materialize(apart, "similar-split")), on).select("x", "c").distinct(), "similar-members")
    if members.isEmpty():
        return first
    rest = prefix_pairs(members, shingle_sets(texts, members.select("x"), words, "similar-member-sets"), similarity)
    return first.unionByName(verified(rest, texts, words, similarity)).distinct()


def node_of(text: Column) -> Column:
    """128 bits that stand for a text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each group, with all its columns: that with the least id (of repeated rows, one)."""
    x = node_of(F.col(text_col))
    made = materialize(signed(docs.select(F.col(id_col).alias("id"), x.alias("x"), F.col(text_col).alias("t")), words), "similar-keys")
    nodes = made.select("x", "n", "fps").dropDuplicates(["x"])
    parts = materialize(connected_components(links(nodes, docs.select(x.alias("x"), F.col(text_col).alias("t")), words, similarity)), "similar-components")
    of = made.select("id", "x").join(broadcast_if_small(parts), F.col("x") == F.col("node"), "left").select("id", "x", F.coalesce("component", "x").alias("c"))
    of = materialize(of, "similar-of")
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "x")
    best = materialize(of.groupBy("c").agg(F.min(rank).alias("b"), F.count(F.lit(1)).alias("many")).filter("many > 1"), "similar-best")
    # groups of one stay without a look at their rows; of others the rows to drop are joined away
    in_many = of.join(broadcast_if_small(best), "c")
    first = F.col("id").eqNullSafe(F.col("b.id")) & (F.col("x") == F.col("b.x"))
    named = lambda df: broadcast_if_small(materialize(df.select(F.col("id").alias("__i"), F.col("x").alias("__x")), "similar-rows"))
    lost, repeated = named(in_many.filter(~first).distinct()), named(in_many.filter(first).groupBy("id", "x").count().filter("count > 1"))
    on = F.col(id_col).eqNullSafe(F.col("__i")) & (F.col("__t") == F.col("__x"))
    kept = docs.withColumn("__t", x).join(lost, on, "left_anti")
    if repeated.isEmpty():
        return kept.drop("__t")
    once = kept.join(repeated, on, "left_semi").groupBy(id_col, "__t").agg(least_row(docs.columns).alias("row")).select("row.*")
    return kept.join(repeated, on, "left_anti").drop("__t").unionByName(once)
