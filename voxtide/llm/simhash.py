"""SimHash near-deduplication through tables of distances to reference fingerprints.

Hamming distances to `MANY` pseudorandom reference fingerprints are computed once per distinct fingerprint, for each
of the `max_bits + SPARE` segments that the bits are cut into; the distance over all bits is their sum. By the triangle
inequality two fingerprints within `max_bits` differ by at most that much in every coordinate, and in the segments where
they don't differ at all (`SPARE` or more) by nothing. So candidates are found by joining on the distances in every
choice of `SPARE` segments; of these pairs, those whose greatest coordinate difference over all bits exceeds
`max_bits` are discarded, and survivors are verified bit by bit.

Where more than `PAIRWISE` fingerprints have the same distances in a choice of segments, references are taken from
their surroundings instead: each fingerprint is written once for every reference at a distance of half of `max_bits`,
rounded up, in the other segments, with that distance. Two fingerprints within `max_bits` share a reference for which
the distances add up to no more, and are linked through the least fingerprint that is nearest. So rows grow with
the input, whatever the groups, and no link is lost. (A fingerprint of such a group makes 33 rows for two bits, 529 for
three or four; `max_bits` above four is possible but not advisable.)

Defined cases: a null or empty text has no words, and with it fingerprint zero, linked like any other; a text of fewer
words than a shingle is one shingle. Rows that repeat an id are documents of their own in `near_duplicates`, which
returns a row for each. A null id ranks behind every other. Other columns are looked at only by `drop_near_duplicates`
where a row is repeated: of rows that agree in id and text the one whose JSON form is least stays.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.graph import connected_components
from .common import broadcast_if_small, least_row, materialize, ship

BITS = 64
SHINGLE_WORDS, MAX_BITS, SEED = 3, 2, 42
SPARE, MANY, PAIRWISE = 2, 16, 32


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Of a text in UTF-8: a bit is 1 if set in over half of the hashes of its shingles, repeats included."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: A-Z and the six ASCII blanks only
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    k = min(shingle_words, len(words))
    start, stop = np.concatenate([[0], ends])[: len(words) - k + 1].tolist(), (ends[k - 1 :] - 1).tolist()
    hashes = np.fromiter((xxh64_intdigest(line[a:b], seed) for a, b in zip(start, stop, strict=True)), np.uint64, len(start))
    n, ones = len(hashes), np.zeros(BITS, np.int64)
    for at in range(0, n, 4096):
        bits = np.unpackbits(hashes[at : at + 4096].view(np.uint8), bitorder="little").reshape(-1, BITS)
        ones += bits.sum(0, dtype=np.uint16)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """(id, fp): the fingerprint as a signed 64-bit integer."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            made = [fingerprint(t.as_py() or b"", shingle_words, seed) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(made, np.uint64).view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, f"id {kind}, fp long")


def segments(max_bits: int) -> list[list[int]]:
    parts = max_bits + SPARE
    return [list(range(BITS * i // parts, BITS * (i + 1) // parts)) for i in range(parts)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _mask(bits: Iterable[int]) -> int:
    return _signed(sum(1 << b for b in bits))


def references(many: int = MANY) -> list[int]:
    """The pseudorandom reference fingerprints."""
    return [int(x) for x in np.random.default_rng(7).integers(-(2**63), 2**63 - 1, many, dtype=np.int64)]


def distance(a: Column, b: Column, within: int = -1) -> Column:
    return F.bit_count(a.bitwiseXOR(b).bitwiseAND(F.lit(within)))


def segment_distances(fp: Column, bits: list[int], many: int = MANY) -> Column:
    """The distances to the references within a segment, modulo 16, as one integer: fingerprints with equal bits there have equal ones."""
    parts = [F.shiftleft(distance(fp, F.lit(r), _mask(bits)).cast("long").bitwiseAND(F.lit(15)), 4 * i) for i, r in enumerate(references(many))]
    return reduce(lambda x, y: x.bitwiseOR(y), parts)


def pivot_table(distinct_fps: DataFrame, max_bits: int = MAX_BITS, many: int = MANY) -> DataFrame:
    """(fp, near, far): distances to the references, `near` within each segment and `far` over all bits."""
    near = F.array(*[segment_distances(F.col("fp"), bits, many) for bits in segments(max_bits)])
    far = F.array(*[distance(F.col("fp"), F.lit(r)).cast("byte") for r in references(many)])
    return distinct_fps.select("fp", near.alias("near"), far.alias("far"))


def links(distinct_fps: DataFrame, max_bits: int = MAX_BITS, many: int = MANY, pairwise: int = PAIRWISE) -> DataFrame:
    """(src, dst): links between distinct fingerprints; those that reach each other are those within chains of `max_bits` steps."""
    spark = distinct_fps.sparkSession
    table = materialize(pivot_table(distinct_fps, max_bits, many), "pivots")
    cut = segments(max_bits)
    choices = list(combinations(range(len(cut)), SPARE))
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), *[F.get("near", F.lit(s)).alias(f"k{j}") for j, s in enumerate(keep)]) for i, keep in enumerate(choices)])).alias("k")
    on = ["choice", *[f"k{j}" for j in range(SPARE)]]
    rows = table.select("fp", "far", keys).select("k.*", "fp", "far")
    sizes = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    sizes = materialize(sizes, "pivot-groups")
    grouped = materialize(rows.join(broadcast_if_small(sizes), on), "pivot-candidates")
    few = grouped.filter(F.col("n") <= pairwise)
    a, b = few.select(*on, F.col("fp").alias("src"), F.col("far").alias("fa")), few.select(*on, F.col("fp").alias("dst"), F.col("far").alias("fb"))
    apart = F.array_max(F.zip_with("fa", "fb", lambda x, y: F.abs(x - y)))
    pairs = a.join(b, on).filter("src < dst").filter(apart <= max_bits).filter(distance(F.col("src"), F.col("dst")) <= max_bits).select("src", "dst")
    large = grouped.filter(F.col("n") > pairwise).select(*on, "fp")
    half = -(-max_bits // 2)
    free = [[b for s, bits in enumerate(cut) if s not in keep for b in bits] for keep in choices]
    steps = [(i, _mask(flip), d) for i, bits in enumerate(free) for d in range(half + 1) for flip in combinations(bits, d)]
    steps = F.broadcast(spark.createDataFrame(steps, "choice int, flip long, d int"))  # a fixed number of rows
    near = large.join(steps, "choice").withColumn("mid", F.col("fp").bitwiseXOR(F.col("flip")))
    # as many fingerprints share a reference as lie around it: no more than a fingerprint makes rows
    nearest = F.min(F.when(F.col("d") <= max_bits // 2, F.col("fp"))).over(Window.partitionBy(*on, "mid"))
    star = near.withColumn("dst", nearest).filter("fp <> dst").select(F.col("fp").alias("src"), "dst")
    return pairs.unionByName(star).distinct()


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: id, fingerprint, component_id (the least id that it reaches)."""
    made = materialize(fingerprints(docs, id_col, text_col, shingle_words), "fingerprints")
    groups = _components(made, max_bits)
    return made.join(groups, "fp", "left").select(F.col("id").alias(id_col), hex16(F.col("fp")).alias("fingerprint"), "component_id")


def _components(made: DataFrame, max_bits: int) -> DataFrame:
    """(fp, component_id, row_id): of each fingerprint, the least id of its component; `made` is a written table."""
    least = materialize(made.groupBy("fp").agg(F.min("id").alias("least")), "fingerprint-ids")
    parts = materialize(connected_components(links(least.select("fp"), max_bits)), "fingerprint-components")
    joined = materialize(least.join(parts, least["fp"] == parts["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("c")), "fingerprint-joined")
    of = materialize(joined.groupBy("c").agg(F.min("least").alias("component_id")), "component-ids")
    return materialize(joined.join(of, "c").select("fp", "component_id", "c"), "fingerprint-groups")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One document of each group, with all its columns: that with the least id (of repeated rows, one)."""
    tie = F.xxhash64(F.col(text_col))
    tied = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    made = materialize(fingerprints(tied.select(F.struct("id", F.xxhash64("t").alias("x")).alias("id"), "t"), "id", "t", shingle_words), "fingerprints")
    groups = _components(made.select("fp", "id"), max_bits)
    best = materialize(made.join(groups.select("fp", "c"), "fp").groupBy("c").agg(F.min(F.struct(F.col("id.id").isNull().alias("none"), "id.id", "id.x")).alias("b"), F.count(F.lit(1)).alias("n")), "near-best")
    # groups of one stay without a look at their rows; of others the rows to drop are joined away
    lost = made.join(groups.select("fp", "c"), "fp").join(best.filter("n > 1"), "c").filter("not (id.id <=> b.id and id.x = b.x)").select(F.col("id.id").alias("__i"), F.col("id.x").alias("__x")).distinct()
    lost = broadcast_if_small(materialize(lost, "near-lost"))
    kept = docs.withColumn("__t", tie).join(lost, F.col(id_col).eqNullSafe(F.col("__i")) & (F.col("__t") == F.col("__x")), "left_anti")
    repeated = materialize(made.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("id.id").alias("__i"), F.col("id.x").alias("__x")), "near-repeated")
    if repeated.isEmpty():
        return kept.drop("__t")
    on = kept[id_col].eqNullSafe(repeated["__i"]) & (kept["__t"] == repeated["__x"])
    once = kept.join(repeated, on, "left_semi").groupBy(id_col, "__t").agg(least_row(docs.columns).alias("row")).select("row.*")
    return kept.join(repeated, on, "left_anti").drop("__t").unionByName(once)
