"""Quality rules whose cutoffs come from mergeable quantile sketches per language and source.

Everything is a DataFrame expression. A sketch is a table of counts per bucket of a log-linear histogram: values below
128 have a bucket each, each later power of two has 64, so a quantile read from it is at most 1/64 above the true one.
Counts of two sketches add up to the sketch of both, whatever the order, so tasks combine them before the shuffle and
small groups fall back to the merged sketch of their language, then of all rows. A rule fails where a document lies
beyond the far fence of its group: the third quartile plus `spread` times the quartile range. No cutoff has a floor or
a fixed value. What a rule measures starts behind a few occurrences that are `free` in any text (a shared line, a
quoted passage, an initial), so that in a group whose texts mostly have none, one more isn't an outlier.

Defined cases: a null text has no words and fails the base rules; null languages and sources are groups of their own;
a table without rows gives none. Columns of the input other than the named ones pass through `adaptive_quality`
unless they have a name that it adds, in which case the added one replaces them; `kept_documents` keeps all columns
as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_ROWS, SPACE, WORD, let, materialize

SYMBOLS = "#*$%&|<>"
WINDOW_WORDS = 5


@dataclass(frozen=True)
class Rule:
    """Per mille of one count, less the `free` first, to another."""

    name: str
    part: str
    whole: str
    free: int


RULES = (
    Rule("symbols", "n_symbols", "n_words", 3),
    Rule("dup_lines", "n_dup_lines", "n_lines", 2),
    Rule("repeats", "n_repeat_words", "n_words", 6 * WINDOW_WORDS),
    Rule("capitals", "n_capitals", "word_chars", 5),
)
SPREAD, LEAST_ROWS = 4, 50
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words(words: Column) -> Column:
    """Words in windows of five words that occur twice or more, the first occurrence included.

    Windows are told apart by a 64-bit hash over their words within one text only.
    """
    w = WINDOW_WORDS

    def windows(a):
        return F.transform(F.sequence(F.lit(0), F.size(a) - w), lambda i: F.xxhash64(*[F.get(a, i + k) for k in range(w)]))

    def covered(h):
        ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def repeated(s):
            def twin(j):
                before = (j > 0) & (F.get(s, j - 1)["h"] == F.get(s, j)["h"])
                after = (j < F.size(s) - 1) & (F.get(s, j + 1)["h"] == F.get(s, j)["h"])
                return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

            at = F.filter(F.transform(s, lambda x, j: F.when(twin(j), x["i"])), lambda x: x.isNotNull())
            return F.sort_array(at)

        def total(p):
            gaps = F.transform(p, lambda x, j: F.least(F.lit(w), F.coalesce(F.get(p, j + 1) - x, F.lit(w))))
            return F.aggregate(gaps, F.lit(0), lambda acc, x: acc + x)

        return let(let(ranked, repeated), total)

    def count(h):
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))

    return let(words, lambda a: F.when(F.size(a) <= w, F.lit(0)).otherwise(let(windows(a), count)))


def metrics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals (all long) and base_failed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda x: x != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    row = let(
        words,
        lambda a: F.struct(F.size(a).cast("long").alias("n_words"), _repeat_words(a).cast("long").alias("n_repeat_words")),
    )
    line = let(lines, lambda a: F.struct(F.size(a).cast("long").alias("n"), (F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("dup")))
    left = lambda pattern: F.length(F.regexp_replace(text, pattern, "")).cast("long")
    chars = F.struct(left(SPACE).alias("n"), left(f"[^{SYMBOLS}]+").alias("symbols"), left(r"[^\p{Lu}]+").alias("capitals"))
    counts = F.struct(row.alias("w"), line.alias("l"), chars.alias("c"))
    # one generated row per document: the optimizer neither copies the counts into each use nor into pushed filters
    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")
    kept = [docs[c] for c in docs.columns if c not in (*made, "base_failed")]
    m = F.col("__m")
    values = (m["w"]["n_words"], m["c"]["n"], m["c"]["symbols"], m["l"]["dup"], m["w"]["n_repeat_words"], m["l"]["n"], m["c"]["capitals"])
    out = docs.select(*kept, F.explode(F.array(counts)).alias("__m"))
    out = out.withColumns(dict(zip(made, values, strict=True))).drop("__m")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def per_mille(rule: Rule) -> Column:
    return F.expr(f"case when {rule.whole} > 0 then 1000 * greatest({rule.part} - {rule.free}, 0) div {rule.whole} else 0 end")


def bucket(v: Column) -> Column:
    """Of a value of 0 or more; integers only, so every engine agrees."""
    e = F.length(F.bin(v)) - 7
    return F.when(v < 128, v).otherwise(64 * e + F.call_function("shiftright", v, e))


def bucket_top(b: Column) -> Column:
    """The largest value of a bucket."""
    e = F.floor(b / 64).cast("int") - 1
    return F.when(b < 128, b).otherwise(F.call_function("shiftleft", (b - 64 * e + 1).cast("long"), e) - 1)


def sketches(measured: DataFrame, lang_col: str = "lang", source_col: str = "source", rules=RULES) -> DataFrame:
    """(lang, source, rule, bucket, n): one sketch for each language, source and rule, of the rows that pass the base rules."""
    each = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), bucket(per_mille(r)).cast("long").alias("bucket")) for r in rules])).alias("x")
    rows = measured.filter(~F.col("base_failed")).select(F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), each)
    return rows.groupBy("lang", "source", "x.rule", "x.bucket").agg(F.count(F.lit(1)).alias("n"))


def merged(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """The sketches that agree in `keys`, merged."""
    return sketch.groupBy(*keys, "rule", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rule, total, q1, q3) read from sketches; a sketch has at most a few thousand buckets."""
    w = Window.partitionBy(*keys, "rule")
    run = sketch.withColumns({"upto": F.sum("n").over(w.orderBy("bucket")), "total": F.sum("n").over(w)})
    at = lambda k: F.min(F.when(4 * F.col("upto") >= k * F.col("total"), F.col("bucket")))
    return run.groupBy(*keys, "rule", "total").agg(bucket_top(at(1)).alias("q1"), bucket_top(at(3)).alias("q3"))


def thresholds(sketch: DataFrame, rules=RULES, spread: int = SPREAD, least_rows: int = LEAST_ROWS) -> DataFrame:
    """(lang, source, and a cutoff per rule): of the group, or of its language, or of all rows, whichever is the first with `least_rows` rows."""
    own = quartiles(sketch, ["lang", "source"])
    lang = quartiles(merged(sketch, ["lang"]), ["lang"]).select(F.col("lang").alias("l2"), F.col("rule").alias("r2"), F.col("total").alias("n2"), F.col("q1").alias("a2"), F.col("q3").alias("b2"))
    every = quartiles(merged(sketch, []), []).select(F.col("rule").alias("r3"), F.col("q1").alias("a3"), F.col("q3").alias("b3"))
    all3 = own.join(lang, F.col("lang").eqNullSafe(F.col("l2")) & (F.col("rule") == F.col("r2"))).join(F.broadcast(every), F.col("rule") == F.col("r3"))
    pick = lambda a, b, c: F.when(F.col("total") >= least_rows, F.col(a)).when(F.col("n2") >= least_rows, F.col(b)).otherwise(F.col(c))
    q1, q3 = pick("q1", "a2", "a3"), pick("q3", "b2", "b3")
    cut = q3 + spread * (q3 - q1)
    return all3.select("lang", "source", "rule", cut.alias("cut")).groupBy("lang", "source").agg(*[F.max(F.when(F.col("rule") == r.name, F.col("cut"))).alias(f"cut_{r.name}") for r in rules])


def judge(measured: DataFrame, cuts: DataFrame, lang_col: str = "lang", source_col: str = "source", rules=RULES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """`measured` with `kept`. `cuts` is a written table; it is broadcast if it has at most `broadcast_rows` rows, else joined (and skewed groups split) by Spark."""
    right = cuts.select(F.col("lang").alias("__l"), F.col("source").alias("__s"), *[F.col(f"cut_{r.name}").alias(f"__{r.name}") for r in rules])
    right = F.broadcast(right) if cuts.count() <= broadcast_rows else right
    joined = measured.join(right, F.col(lang_col).eqNullSafe(F.col("__l")) & F.col(source_col).eqNullSafe(F.col("__s")), "left")
    fine = ~F.col("base_failed")
    for r in rules:
        fine = fine & (per_mille(r) <= F.coalesce(F.col(f"__{r.name}"), F.lit(2**40)))
    return joined.withColumn("kept", fine).drop("__l", "__s", *[f"__{r.name}" for r in rules])


def adaptive_quality(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", rules=RULES, spread: int = SPREAD, least_rows: int = LEAST_ROWS) -> DataFrame:
    """`docs` with the counts of `metrics`, `base_failed` and `kept`. Texts are read twice: for the sketches and for the verdicts."""
    measured = metrics(docs, text_col)
    cuts = materialize(thresholds(materialize(sketches(measured, lang_col, source_col, rules), "rule-sketches"), rules, spread, least_rows), "rule-cuts")
    return judge(measured, cuts, lang_col, source_col, rules)


def kept_documents(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of `docs` that the rules keep, with all their columns as they are. Rows are written with their counts, which are made once."""
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    cols = [row, F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("t")]
    measured = materialize(metrics(docs.select(*cols), "t").drop("t"), "rule-rows")
    cuts = materialize(thresholds(materialize(sketches(measured), "rule-sketches")), "rule-cuts")
    return judge(measured, cuts).filter("kept").select("row.*")


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Counts and verdict per document without its text, for which texts are read once: the counts are written and read again."""
    cols = [F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("t")]
    measured = materialize(metrics(docs.select(*cols), "t").drop("t"), "rule-counts")
    cuts = materialize(thresholds(materialize(sketches(measured), "rule-sketches")), "rule-cuts")
    return judge(measured, cuts).select(F.col("id").alias(id_col), *BASE, "base_failed", "kept")
