"""Quality scores by positive-unlabelled learning.

Trusted positives are rows labelled 1; all other text, whatever it is labelled, is unlabelled web text. A small network
over counts of a text and its words, hashed to `BINS` bins, minimises the non-negative unbiased risk: with class prior p, the risk of positives taken for
positives, times p, plus the risk of unlabelled text taken for negatives less p times that of positives taken for
negatives, where the last difference is kept from falling below zero (when it does, its gradient is followed upwards
instead). The prior is estimated as the share of ones among the labels that may teach; where these hold no zero, as
the value at which positives and unlabelled text score alike on average (Elkan and Noto).

Fitting takes at most `POSITIVES` and `UNLABELLED` rows, chosen by a 64-bit hash of their ids; a sample that comes out
short is drawn again from more rows. Texts are counted where they are read, and only the counts of the sample are
sorted and reach the driver. Scoring reads every whole text.

Defined cases: null and empty texts are scored as texts without words; a document that is labelled more than once
counts with its highest label; without a trusted positive every score is 0.5. Other columns are never looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import log, sqrt
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize, sample_cut, ship
from .langid import held_out

POSITIVES, UNLABELLED = 5000, 10_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY, SEED = 24, 60, 512, 5e-3, 1e-3, 5
THRESHOLD = 0.7
UPPER, DIGITS = bytes(range(65, 91)), b"0123456789"
SYMBOLS, PUNCTUATION = b"#*$%&|<>", b".,;:!?'\"()-"
BINS = 128
N_FEATURES = 18 + BINS


def features(text: bytes) -> list[float]:
    """Shares and logarithms of counts of a text in UTF-8, and the direction of its words' counts in hashed bins."""
    n = len(text)
    words = text.split()
    nw = len(words)
    if not nw:
        return [0.0] * 17 + [1.0] + [0.0] * BINS
    lines = [x for x in text.split(b"\n") if not x.isspace() and x]
    count = Counter(words)
    top = max(count.values())
    has = lambda chars: n - len(text.translate(None, chars))
    twice = sum(map(bytes.__eq__, words, words[1:]))
    pairs = set(zip(words, words[1:], strict=False))
    solid = sum(map(len, words))
    bins = [0.0] * BINS
    for word, times in count.items():
        bins[crc32(word.lower()) % BINS] += 1 + log(times)
    length = sqrt(sum(x * x for x in bins))
    return [
        has(SYMBOLS) / nw, text.count(b"|") / nw, text.count(b"!") / nw, has(UPPER) / solid, has(DIGITS) / solid, has(PUNCTUATION) / nw,
        len(count) / nw, len(count) / nw**0.8, top / nw, twice / nw, 1 - len(pairs) / max(1, nw - 1), solid / nw, np.log1p(nw), np.log1p(len(lines)),
        1 - len(set(lines)) / max(1, len(lines)), nw / max(1, len(lines)), text.count(b"http") / nw, 0.0,
        *(x / length for x in bins),
    ]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    prior: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(z @ w1 + b1) @ w2 + b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = SEED) -> Model:
    """Minimise the non-negative risk with the logistic loss, by Adam over paired batches."""
    rng = np.random.default_rng(seed)
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-6
    k = positive.shape[1]
    layers = [rng.normal(0, k**-0.5, (k, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    m, v, t = [np.zeros_like(x) for x in layers], [np.zeros_like(x) for x in layers], 0
    model = Model(mean, scale, layers, prior)
    z = lambda x: np.clip((x - mean) / scale, -8, 8)
    zp, zu = z(positive), z(unlabelled)
    for _ in range(EPOCHS):
        order = rng.permutation(len(zu))
        for lo in range(0, len(zu), BATCH):
            u = zu[order[lo : lo + BATCH]]
            p = zp[rng.integers(0, len(zp), min(BATCH, len(zp)))]
            x = np.concatenate([p, u])
            h = np.tanh(x @ layers[0] + layers[1])
            g = h @ layers[2] + layers[3]
            gp, gu = g[: len(p)], g[len(p) :]
            # loss log(1 + e^-g) for positives, log(1 + e^g) for negatives
            below = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
            d_neg = np.concatenate([-prior * _sigmoid(gp) / len(p), _sigmoid(gu) / len(u)])
            d_pos = np.concatenate([-prior * _sigmoid(-gp) / len(p), np.zeros(len(u))])
            d = d_pos + d_neg if below >= 0 else -d_neg
            dh = d[:, None] * layers[2] * (1 - h * h)
            t += 1
            for i, grad in enumerate([x.T @ dh + DECAY * layers[0], dh.sum(0), h.T @ d + DECAY * layers[2], d.sum(keepdims=True)]):
                m[i] = 0.9 * m[i] + 0.1 * grad
                v[i] = 0.999 * v[i] + 0.001 * grad * grad
                layers[i] -= RATE * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return model


def _counted(rows: DataFrame) -> DataFrame:
    """(id, h, x) of (id, h, t): the features of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [np.array(features(t.as_py() or b""), np.float32).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], ["id", "h", "x"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, h boolean, x binary")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model | None:
    spark = docs.sparkSession
    ship(spark)
    teach = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).filter(F.col("id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    n, ones = teach.agg(F.count("*"), F.coalesce(F.sum((F.col("y") == 1).cast("long")), F.lit(0))).first()
    if not ones:
        return None
    order, every = F.xxhash64(F.col("id"), F.lit(13)), 2**63 - 1
    rows = docs.select(F.col(id_col).alias("id"), F.lit(False).alias("h"), F.col(text_col).cast("binary").alias("t"))

    def drawn(source: DataFrame, texts: Callable[[DataFrame], DataFrame], want: int, have: int, tag: str) -> np.ndarray:
        """The features of the first `want` rows by hash: counted, written, and only then sorted."""
        wider = 1
        while True:
            cut = sample_cut(wider * (1.2 * want + 60), have)
            made = materialize(_counted(texts(source.filter(order <= cut))).select("id", order.alias("place"), "x"), tag)
            if cut == every or made.count() >= want:
                break
            wider *= 8
        first = made.orderBy("place", "id", "x").limit(want)  # places agree only where ids do
        return np.array([np.frombuffer(r["x"], np.float32) for r in first.collect()], np.float64).reshape(-1, N_FEATURES)

    xp = drawn(teach.filter("y = 1").select("id"), lambda ids: rows.join(broadcast_if_small(materialize(ids, "pu-ids")), "id", "left_semi"), positives, ones, "pu-positives")
    # with trusted positives left in, unlabelled text is a sample of all text, for which the prior holds
    xu = drawn(rows, lambda some: some, unlabelled, docs.count(), "pu-unlabelled")
    if not len(xp) or not len(xu):
        return None
    if ones < n:
        return fit(xp, xu, ones / n)
    first = fit(xp, xu, 0.5)
    return fit(xp, xu, float(np.clip(first.score(xu).mean() / max(1e-6, first.score(xp).mean()), 0.05, 0.95)))


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, held_out, score, predicted."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            x = np.array([features(t.as_py() or b"") for t in batch.column(2)], float).reshape(-1, N_FEATURES)
            s = model.score(x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["id", "held_out", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("h"), F.col(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(run, f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return score(docs, train(docs, labels, id_col, text_col), id_col, text_col)
