"""Benchmark decontamination by winnowing, in DataFrame expressions only.

Of every `WINDOW` consecutive hashes of runs of `GRAM` words the least is kept as a fingerprint. A span of
`GRAM + WINDOW - 1` words (ten) that a document and a benchmark item share has the same hashes in both, hence the same
least one: no such span is missed. Fingerprints of both are joined; at each place where they meet, the words are
compared, and the match is extended to both sides, by as many words as a span around it can have. If that makes ten
words or more, all of them lie in shared spans. Items of fewer than ten words are one window of their own length; for
each such length (nine at most) documents have every hash of so many words as a fingerprint, and nothing is extended.

Documents are cut into blocks of `BLOCK` words that overlap by nine, so whatever a text's length, what is carried to
the join is a block, and each span lies within one. The benchmark's fingerprints are broadcast where they were counted to
be at most `broadcast_rows`; beyond it both sides are shuffled by hash, and Spark splits the documents' side of a common
hash. Hit words are bits of a mask for each 64 words of a text; masks are combined in the tasks before they are
shuffled, and so are equal texts, which are told by their SHA-256: a passage or text that a third of all rows have is a
row of each task. The results of texts are joined back by broadcast up to `broadcast_rows` texts, beyond it by hash, but
texts with over one in `HOT_TEXTS` of the rows that are hit are always broadcast.

Defined cases: null texts have no words, as documents and as items; items without words occur nowhere; rows of the
benchmark with one id are one item; a null id of an item is written as an empty string; documents repeat their result
with their rows, whatever their ids; without items nothing is hit; other columns aren't looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, let, materialize

#: What is between words once A-Z are lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GRAM, WINDOW = 5, 6
SPAN = GRAM + WINDOW - 1
REACH = SPAN - GRAM
BLOCK, CELL, HOT_TEXTS = 256, 64, 100_000


def words_of(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lower, BETWEEN), lambda x: x != "")


def gram_hashes(words: Column, n: int, short: bool) -> Column:
    """Hashes of each `n` consecutive words; those of short items are kept apart from the others."""
    one = lambda i: F.xxhash64(F.lit(n if short else 0), *[F.get(words, i + k) for k in range(n)])
    return F.when(F.size(words) < n, F.array().cast("array<long>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - n, F.lit(0))), one))


def least_hashes(hashes: Column) -> Column:
    """The least of each `WINDOW` consecutive hashes, each value once; none of fewer hashes."""
    least = lambda i: F.least(*[F.get(hashes, i + k) for k in range(WINDOW)])
    made = F.transform(F.sequence(F.lit(0), F.greatest(F.size(hashes) - WINDOW, F.lit(0))), least)
    return F.when(F.size(hashes) < WINDOW, F.array().cast("array<long>")).otherwise(F.array_distinct(made))


def _series(words: Column, n: int) -> Column:
    """The hashes of a block for items of `n` words (`SPAN`: of so many or more) and which of them are fingerprints."""
    if n == SPAN:
        return let(gram_hashes(words, GRAM, False), lambda h: F.struct(F.lit(GRAM).alias("gram"), h.alias("hashes"), least_hashes(h).alias("prints")))
    return let(gram_hashes(words, n, True), lambda h: F.struct(F.lit(n).alias("gram"), h.alias("hashes"), F.array_distinct(h).alias("prints")))


def item_prints(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(h, gram, least, words, before, after, item): fingerprints of items with the words at them and around; `least` is how many must agree."""
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.explode(F.array(words_of(F.col(text_col)))).alias("w")).filter("size(w) > 0").distinct()
    n = F.least(F.size("w"), F.lit(SPAN))
    made = rows.select("item", "w", n.alias("least"), F.when(n == SPAN, F.lit(GRAM)).otherwise(n).alias("gram"))
    all_series = [F.when(F.col("least") == n, _series(F.col("w"), n)) for n in range(1, SPAN + 1)]
    made = made.withColumn("s", F.explode(F.array(F.coalesce(*all_series))))
    made = made.withColumn("h", F.explode("s.prints"))
    at = F.filter(F.transform("s.hashes", lambda x, i: F.when(x == F.col("h"), i)), lambda x: x.isNotNull())
    made = made.withColumn("at", F.explode(at))
    reach = F.when(F.col("least") == SPAN, F.lit(REACH)).otherwise(0)
    around = {
        "words": F.slice("w", F.col("at") + 1, F.col("gram")),
        # nearest first
        "before": F.reverse(F.slice("w", F.greatest(F.col("at") - reach, F.lit(0)) + 1, F.least(reach, F.col("at")))),
        "after": F.slice("w", F.col("at") + F.col("gram") + 1, reach),
    }
    return made.withColumns(around).select("h", "gram", "least", "words", "before", "after", "item").distinct()


def blocks(words: Column) -> Column:
    """Structs of the first word's number and the words of each block; every span is within one of them."""
    cut = lambda b: F.struct(b.alias("base"), F.slice(words, b + 1, F.lit(BLOCK + SPAN - 1)).alias("w"))
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - SPAN, F.lit(0)), F.lit(BLOCK)), cut)


def _agree(mine: list[Column], theirs: Column) -> Column:
    """How many words agree before the first that doesn't."""
    out = F.lit(0)
    for j in reversed(range(len(mine))):
        out = F.when(F.coalesce(mine[j] == F.get(theirs, F.lit(j)), F.lit(False)), 1 + out).otherwise(0)
    return out


def hits(docs: DataFrame, prints: DataFrame, lengths: list[int], text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(h, start, stop, item): runs of words of texts, by their hash, that lie in spans they share with items, none longer than `GRAM + 2 * REACH` words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)).alias("sha"), F.explode(F.array(words_of(text))).alias("all")).filter("size(all) > 0")
    rows = rows.select("sha", F.explode(blocks(F.col("all"))).alias("b")).select("sha", "b.base", "b.w")
    rows = rows.withColumn("s", F.explode(F.array(*[_series(F.col("w"), n) for n in lengths])))
    rows = rows.select("sha", "base", "w", F.col("s.hashes").alias("hashes"), F.explode("s.prints").alias("h"))
    right = prints if prints.count() > broadcast_rows else F.broadcast(prints)
    met = rows.join(right, "h")
    at = F.filter(F.transform("hashes", lambda x, i: F.when(x == F.col("h"), i)), lambda x: x.isNotNull())
    met = met.withColumn("at", F.explode(at)).filter(F.slice("w", F.col("at") + 1, F.col("gram")) == F.col("words"))
    left = _agree([F.get("w", F.col("at") - 1 - j) for j in range(REACH)], F.col("before"))
    right_ = _agree([F.get("w", F.col("at") + F.col("gram") + j) for j in range(REACH)], F.col("after"))
    met = met.withColumns({"l": left, "r": right_}).filter("l + gram + r >= least")
    start = F.col("base") + F.col("at")
    return met.select("sha", (start - F.col("l")).cast("long").alias("start"), (start + F.col("gram") + F.col("r")).cast("long").alias("stop"), "item")


def hit_words(found: DataFrame) -> DataFrame:
    """(sha, n_hit): words of a text in any run, by masks of `CELL` words each."""
    cell = lambda x: F.floor(x / CELL)
    rows = found.select("sha", "start", "stop", F.explode(F.sequence(cell(F.col("start")), cell(F.col("stop") - 1))).alias("cell"))
    lo = F.greatest(F.col("start") - F.col("cell") * CELL, F.lit(0)).cast("int")
    hi = F.least(F.col("stop") - F.col("cell") * CELL, F.lit(CELL)).cast("int")
    ones = F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), CELL - (hi - lo))
    masks = rows.select("sha", "cell", F.call_function("shiftleft", ones, lo).alias("mask"))
    return masks.groupBy("sha", "cell").agg(F.bit_count(F.bit_or("mask")).cast("long").alias("n")).groupBy("sha").agg(F.sum("n").alias("n_hit"))


def found_items(found: DataFrame) -> DataFrame:
    """(sha, n_items, items_sha256): the items that a text shares spans with; a row holds no more than the benchmark's ids."""
    pairs = found.select("sha", "item").distinct().groupBy("sha").agg(F.sort_array(F.collect_list("item")).alias("items"))
    return pairs.select("sha", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"))


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Per document: its id, n_words, n_hit (words in spans shared with items), n_items, items_sha256 (of their ids, sorted as strings, with commas between), contaminated."""
    prints = materialize(item_prints(items, item_id_col, item_text_col), "winnow-items")
    lengths = sorted(r["least"] for r in prints.select("least").distinct().collect())
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).alias("id"), F.regexp_count(text, F.lit(ANY_WORD)).cast("long").alias("n_words"), F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)).alias("sha"))
    if lengths:
        runs = hits(docs, prints, lengths, text_col, broadcast_rows)
        found = materialize(runs.groupBy("sha", "start", "stop", "item").agg(F.count(F.lit(1)).alias("n")), "winnow-runs")
        weight = found.groupBy("sha").agg(F.max("n").alias("weight"))  # in proportion to the rows with the text
        result = materialize(hit_words(found).join(found_items(found), "sha").join(weight, "sha"), "winnow-texts")
        own = _with_results(own, result, broadcast_rows)
    else:
        own = own.withColumns({"n_hit": F.lit(None).cast("long"), "n_items": F.lit(None).cast("long"), "items_sha256": F.lit(None).cast("string")})
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    n_items, digest = F.coalesce("n_items", F.lit(0).cast("long")), F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256))
    return own.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), n_items.alias("n_items"), digest.alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def _with_results(own: DataFrame, result: DataFrame, broadcast_rows: int) -> DataFrame:
    """`own` with the results of its texts: few are broadcast; of many, those of the commonest texts, which can be no more than `HOT_TEXTS`."""
    if result.count() <= broadcast_rows:
        return own.join(F.broadcast(result), "sha", "left")
    least = result.agg(F.sum("weight")).first()[0] // HOT_TEXTS
    hot = F.broadcast(result.filter(F.col("weight") > least))
    cold = own.join(hot.select("sha"), "sha", "left_anti").join(result.filter(F.col("weight") <= least).hint("merge"), "sha", "left")
    return own.join(hot, "sha").unionByName(cold)


def decontaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of `docs` that share no span with an item, with their columns as they are."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col(text_col).alias("t"))
    marked = contamination(rows, items, "row", "t", item_id_col, item_text_col, broadcast_rows)
    return marked.filter(~F.col("contaminated")).select("row.*")
