"""Language identification by string kernels.

The kernel of two texts counts the letter n-grams of 1 to 3 characters that are present in both (a blended spectrum of
presence kernels), divided by the roots of the texts' own counts. N-grams are exact: three characters fit one 64-bit
code. Landmark texts give a Nyström map of the kernel, in which one kernel ridge regression per language against the
rest is solved. A kernel against a landmark needs only the landmark's n-grams, so the landmarks' n-grams are the
vocabulary, and landmarks and regression weights multiply into one matrix of vocabulary by languages. A batch of texts
is scored by one product of its (sparse) presence rows with that matrix.

Fitting takes at most `TRAIN_ROWS` labelled texts and `LANDMARKS` of these, dealt evenly over all languages, of each one at
least, and chosen by a 64-bit hash of id and text; texts of up to `LANDMARK_CHARS`
characters are landmarks before longer ones. A sample that comes out short is drawn again from more rows, whatever the
size of the table. The driver gets the landmarks' n-grams and a row of kernel values per text of the sample; scoring reads
every whole text.

Defined cases: a null text, and one without a letter, is `und` with score 0; rows without a language don't teach;
if none teaches, all texts are `und`. Case is ignored, and all that isn't a letter separates words. Rows that repeat
teach once and are scored alike; other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, sample_cut, ship

ORDERS = (1, 2, 3)
LANDMARKS, TRAIN_ROWS, LANDMARK_CHARS, RIDGE = 256, 4000, 20_000, 1e-2
BATCH, CHUNK = 256, 1 << 18
UNKNOWN = "und"
#: How sharply margins become scores.
SHARPNESS = 6.0

_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def grams(text: str | None) -> np.ndarray | None:
    """The n-grams of a text, once each and sorted, as codes of 21 bits a character; None if the text has no letter."""
    found, last = [], 32
    for at in range(0, len(text or ""), CHUNK):
        codes = np.frombuffer(text[at : at + CHUNK].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(_letters()[codes], codes, 32).astype(np.int64)
        if at + CHUNK >= len(text):
            codes = np.append(codes, 32)
        codes = np.concatenate([np.atleast_1d(last), codes])
        # of several separators in a row one stays; a chunk goes on with the last two characters of the one before it
        keep = np.append(True, (codes[1:] != 32) | (codes[:-1] != 32))
        if np.ndim(last):
            keep[: len(last)] = True
        codes = codes[keep]
        gram, parts = codes, [codes]
        for n in ORDERS[1:]:
            gram = (gram[:-1] << 21) | codes[n - 1 :]
            parts.append(gram)
        found.append(np.unique(np.concatenate(parts)))
        last = codes[-2:]
    out = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    out = out[out != 32]  # the separator alone tells nothing
    return out if len(out) else None


@dataclass
class Landmarks:
    """Texts as their n-grams, and for each n-gram of the vocabulary the landmarks that have it."""

    languages: list[str]
    texts: list[np.ndarray]

    def __post_init__(self):
        every = np.concatenate(self.texts)
        order = np.argsort(every, kind="stable")
        self.vocabulary, first, count = np.unique(every[order], return_index=True, return_counts=True)
        self.owner = np.repeat(np.arange(len(self.texts)), [len(t) for t in self.texts])[order]
        self.first, self.count = first, count
        self.roots = np.sqrt([len(t) for t in self.texts])

    def places(self, text: np.ndarray) -> np.ndarray:
        return places(self.vocabulary, text)

    def kernel(self, text: np.ndarray) -> np.ndarray:
        """The kernel of a text's n-grams with each landmark."""
        at = self.places(text)
        size = self.count[at]
        steps = np.repeat(self.first[at] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.bincount(self.owner[steps], minlength=len(self.texts)) / (self.roots * np.sqrt(len(text)))


def places(vocabulary: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Where in the vocabulary the n-grams of a text are that it has."""
    at = np.searchsorted(vocabulary, text)
    at[at == len(vocabulary)] = 0
    return at[vocabulary[at] == text]


@dataclass
class Model:
    languages: list[str]
    vocabulary: np.ndarray
    weights: np.ndarray  # vocabulary x languages

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        """Margins of texts given as their n-grams, for each language against the rest."""
        at = [places(self.vocabulary, t) for t in texts]
        size = np.array([len(x) for x in at])
        rows = np.concatenate([self.weights[np.concatenate(at)], np.zeros((1, len(self.languages)))])
        out = np.add.reduceat(rows, np.minimum(np.cumsum(size) - size, len(rows) - 1), axis=0)
        return np.where(size[:, None] > 0, out, 0.0) / np.sqrt([[len(t)] for t in texts])


def fit(marks: Landmarks, kernel: np.ndarray, languages: list[str], ridge: float = RIDGE) -> Model:
    """`kernel`: a row per labelled text, its kernel with each landmark; `languages`: of these texts."""
    names = sorted(set(languages))
    label = np.searchsorted(names, languages)
    value, vector = np.linalg.eigh(np.array([marks.kernel(t) for t in marks.texts]))
    ok = value > 1e-8 * value.max()
    root = vector[:, ok] / np.sqrt(value[ok])
    mapped = kernel @ root
    goal = np.where(label[:, None] == np.arange(len(names)), 1.0, -1.0)
    weight = 1.0 / np.bincount(label, minlength=len(names))[label]  # languages count alike
    gram = (mapped * weight[:, None]).T @ mapped
    solved = np.linalg.solve(gram + ridge * np.eye(gram.shape[0]), (mapped * weight[:, None]).T @ goal)
    each = (root @ solved) / marks.roots[:, None]
    weights = np.add.reduceat(each[marks.owner], marks.first, axis=0)
    return Model(names, marks.vocabulary, weights)


def held_out(id_col: Column) -> Column:
    """Rows whose crc32(id as text) leaves 2 when divided by 4; they teach nothing."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS) -> DataFrame | None:
    """(lang, place, t): at most `rows` labelled texts that aren't held out, dealt evenly over the languages (one of each, where there are more of these); a written table."""
    order = F.xxhash64(F.col(id_col), F.col(text_col), F.lit(11))
    pool = docs.select(F.col(lang_col).cast("string").alias("lang"), order.alias("place"), F.col(text_col).alias("t"), held_out(F.col(id_col)).alias("h"))
    pool = pool.filter(F.col("lang").isNotNull() & F.col("t").isNotNull() & ~F.col("h"))
    counts = pool.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # a row per language
    if not counts:
        return None
    each, wider = max(1, rows // len(counts)), 1
    while True:
        cuts = {r["lang"]: sample_cut(wider * (1.2 * each + 60), r["n"]) for r in counts}
        cut = F.create_map(*[x for k, v in cuts.items() for x in (F.lit(k), F.lit(v))])
        drawn = pool.filter(F.col("place") <= F.try_element_at(cut, F.col("lang"))).groupBy("lang", "place").agg(F.min("t").alias("t"))
        first = F.row_number().over(Window.partitionBy("lang").orderBy("place"))
        drawn = materialize(drawn.withColumn("nth", first).filter(F.col("nth") <= each).drop("nth"), "language-sample")
        got = {r["lang"]: r["count"] for r in drawn.groupBy("lang").count().collect()}
        if all(got.get(k, 0) >= each or v == 2**63 - 1 for k, v in cuts.items()):
            return drawn
        wider *= 8  # rows that repeat count once, so a sample may come out short


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS, landmarks: int = LANDMARKS) -> Model | None:
    """Fit on the texts of `sample`."""
    spark = docs.sparkSession
    ship(spark)
    drawn = sample(docs, id_col, text_col, lang_col, rows)
    if drawn is None:
        return None

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [grams(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([m is not None and m.tobytes() or None for m in made], pa.binary())], ["lang", "place", "bits"])

    places_of = drawn.withColumn("long", F.length("t") > LANDMARK_CHARS).withColumn("lettered", F.regexp_like("t", F.lit(r"\p{L}"))).filter("lettered")
    known = places_of.select("lang").distinct().count()
    if not known:
        return None
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("long", "place"))
    chosen = places_of.withColumn("nth", nth).filter(F.col("nth") <= max(1, landmarks // known)).select("lang", "place", "t")
    got = sorted((r["lang"], r["place"], bytes(r["bits"])) for r in chosen.mapInArrow(coded, "lang string, place long, bits binary").filter("bits is not null").collect())
    if not got:
        return None
    marks = Landmarks([x for x, *_ in got], [np.frombuffer(b, np.int64) for *_, b in got])
    held = spark.sparkContext.broadcast(marks)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = held.value
        for batch in batches:
            made = [grams(t.as_py()) for t in batch.column(2)]
            rows = [None if m is None else marks.kernel(m).tobytes() for m in made]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], ["lang", "place", "bits"])

    rows_ = sorted((r["lang"], r["place"], bytes(r["bits"])) for r in drawn.mapInArrow(mapped, "lang string, place long, bits binary").filter("bits is not null").collect())
    kernel = np.frombuffer(b"".join(b for *_, b in rows_), np.float64).reshape(len(rows_), -1)
    return fit(marks, kernel, [x for x, *_ in rows_])


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, lang_pred, score."""
    ship(docs.sparkSession)
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            langs, scores = [], []
            for lo in range(0, batch.num_rows, BATCH):
                texts = [grams(t.as_py()) for t in batch.column(2).slice(lo, BATCH)]
                known = np.array([t is not None for t in texts])
                if model is None or not known.any():
                    langs += [UNKNOWN] * len(texts)
                    scores += [0.0] * len(texts)
                    continue
                margin = np.zeros((len(texts), len(model.languages)))
                margin[known] = model.scores([t for t in texts if t is not None])
                p = np.exp(SHARPNESS * (margin - margin.max(1, keepdims=True)))
                p /= p.sum(1, keepdims=True)
                best = p.argmax(1)
                langs += [model.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
                scores += np.where(known, p[np.arange(len(best)), best], 0.0).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["id", "held_out", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("h"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, f"id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    return identify(docs, train(docs, id_col, text_col, lang_col), id_col, text_col)
