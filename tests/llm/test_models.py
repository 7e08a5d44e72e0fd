import re
import zlib
from collections import Counter

import numpy as np
from voxtide.llm import common, langid, pu


def test_languages_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = docs.select("doc_id", "lang").toPandas().set_index("doc_id").lang
    got = langid.identify_languages(docs).toPandas().set_index("doc_id")
    held = got[got.held_out]
    assert len(held) > 200 and (held.lang_pred == truth[held.index]).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_language_cases(spark):
    schema = "doc_id long, text string, lang string, score string"
    rows = [(i, "the cat and the dog", "en", "") for i in range(8)] + [(i, "der Hund und die Katze", "de", "") for i in range(8, 16)]
    odd = [(100, None, "en", ""), (101, "", None, ""), (102, "12 ?! 3", "de", ""), (None, "und die", None, ""), (103, "THE DOG " * 20_000, None, "")]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify_languages(spark.createDataFrame(rows + odd, schema)).collect()}
    assert [got[k] for k in (100, 101, 102, None, 103)] == ["und", "und", "und", "de", "en"]
    unlabelled = spark.createDataFrame([(1, "abc", None, "")], schema)
    assert [r["lang_pred"] for r in langid.identify_languages(unlabelled).collect()] == ["und"]
    assert langid.identify_languages(spark.createDataFrame([], schema)).collect() == []


def ngrams(text):
    """The n-grams of a text as strings."""
    line = " " + re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in text.lower())).strip(" ") + " "
    return {line[i : i + n] for n in (1, 2, 3) for i in range(len(line) - n + 1)} - {" "}


def test_ngrams_across_chunks(monkeypatch):
    texts = ["a", "Hello, World! 12 ab  c", " x", "日本語のテスト。日本", "é" * 9, "İstanbul ve ĞÜŞ", "a  " * 20, "ab, cd; ef. gh" * 3]
    for chunk in (1, 2, 3, 5, 1000):
        monkeypatch.setattr(langid, "CHUNK", chunk)
        for t in texts:
            codes = langid.grams(t)
            made = {"".join(chr(int(c) >> k & 0x1FFFFF) for k in (42, 21, 0) if int(c) >> k) for c in codes}
            assert made == ngrams(t), (chunk, t)
    assert langid.grams("12 !") is None and langid.grams("") is None and langid.grams(None) is None


def test_predictions_against_brute_force(spark):
    """Kernel matrices between sets of strings and the dual ridge regression, text by text."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    drawn = sorted((r["lang"], r["place"], r["t"]) for r in langid.sample(docs).collect())
    names = sorted({x for x, *_ in drawn})
    each = max(1, 32 // len(names))
    marks = [x for k in names for x in [y for y in drawn if y[0] == k and len(y[2]) <= langid.LANDMARK_CHARS][:each]]
    sets = {t: ngrams(t) for *_, t in drawn}
    kernel = lambda a, b: len(a & b) / np.sqrt(len(a) * len(b))
    m = np.array([[kernel(sets[a[2]], sets[b[2]]) for b in marks] for a in marks])
    k = np.array([[kernel(sets[a[2]], sets[b[2]]) for b in marks] for a in drawn])
    label = np.array([names.index(x[0]) for x in drawn])
    weight = 1 / np.bincount(label)[label]
    goal = np.where(label[:, None] == np.arange(len(names)), 1.0, -1.0)
    # Nyström ridge regression in the landmarks' own coordinates
    coef = np.linalg.pinv(k.T @ (weight[:, None] * k) + langid.RIDGE * m, rcond=1e-13) @ k.T @ (weight[:, None] * goal)
    model = langid.train(docs, landmarks=32)
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    for r in docs.collect():
        own = ngrams(r["text"] or "")
        margin = np.array([kernel(own, sets[b[2]]) for b in marks]) @ coef
        p = np.exp(langid.SHARPNESS * (margin - margin.max()))
        assert got[r["doc_id"]]["lang_pred"] == names[int(margin.argmax())]
        assert abs(got[r["doc_id"]]["score"] - p.max() / p.sum()) < 1e-3


def test_samples_of_any_table():
    """The cut in 64-bit hashes lets a full sample through, however many rows there are."""
    for have in (10, 10**6, 10**11, 10**13):
        for want in (60, 1260, 12_000):
            cut = common.sample_cut(want, have)
            share = (cut + 2**63) / 2**64
            assert cut == 2**63 - 1 if want >= have else abs(share * have - want) < 1e-3 * want


def test_every_language_is_learned(spark):
    """Of more languages than texts to learn from, or than landmarks, one text each."""
    words = lambda k: " ".join(chr(0x4E00 + 40 * k + (i * 7) % 40) * 2 for i in range(30))
    rows = [(i, words(i % 230), f"l{i % 230:03d}") for i in range(1150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.sample(docs, rows=50).select("lang").distinct().count() == 230
    got = langid.identify(docs, langid.train(docs, rows=50, landmarks=8)).toPandas()
    want = {i: lang for i, _, lang in rows}
    assert (got["lang_pred"] == got["doc_id"].map(want)).mean() == 1


def test_repeated_rows_teach_once(spark):
    rows = [(1, "the cat sat on the mat", "en")] * 500 + [(2, "der Hund und die Katze", "de")] * 3 + [(i, f"the dog {'ab'[i % 2]} and the cat", "en") for i in range(3, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    drawn = langid.sample(docs, rows=20)
    got = {r["lang"]: r["count"] for r in drawn.groupBy("lang").count().collect()}
    assert got["en"] == 10 and got["de"] <= 1
    assert len({(r["lang_pred"], r["score"]) for r in langid.identify_languages(docs).filter("doc_id = 1").collect()}) == 1


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = pu.score_quality(docs, labels).toPandas().set_index("doc_id").join(labels.toPandas().set_index("doc_id"), how="inner")
    held = got[got.held_out]
    assert ((held.predicted == 1) == (held.quality == 1)).mean() > 0.93
    assert got.score.between(0, 1).all()


def test_quality_cases(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "a b", 0), (3, "x " * 100_000, 0)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in pu.score_quality(docs, labels).collect()} == {0.5}
    ones = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 1, None), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    assert len(pu.score_quality(docs, ones).collect()) == 4
    assert pu.score_quality(docs.limit(0), ones).collect() == []


def test_risk_is_minimised_without_negatives():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(1.5, 1, (3000, pu.N_FEATURES)), rng.normal(-1.5, 1, (1000, pu.N_FEATURES))
    model = pu.fit(good[:1000], np.concatenate([good[1000:], bad[:667]]), 0.75)
    assert model.score(good[1000:]).mean() > 0.85 and model.score(bad[667:]).mean() < 0.15


def counted(text):
    """The features of a text, counted one by one."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return [0.0] * 17 + [1.0] + [0.0] * pu.BINS
    n = len(words)
    raw, solid = [w.encode() for w in words], sum(len(w.encode()) for w in words)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    times = Counter(words)
    has = lambda chars: sum(text.count(c) for c in chars)
    bins = [0.0] * pu.BINS
    for w, k in times.items():
        bins[zlib.crc32(w.encode().lower()) % pu.BINS] += 1 + np.log(k)
    pairs = list(zip(words, words[1:], strict=False))
    own = [
        has("#*$%&|<>") / n, has("|") / n, has("!") / n, sum("A" <= c <= "Z" for c in text) / solid, sum("0" <= c <= "9" for c in text) / solid, has(".,;:!?'\"()-") / n,
        len(times) / n, len(times) / n**0.8, max(times.values()) / n, sum(a == b for a, b in pairs) / n, 1 - len(set(pairs)) / max(1, n - 1), sum(map(len, raw)) / n,
        np.log1p(n), np.log1p(len(lines)), 1 - len(set(lines)) / max(1, len(lines)), n / max(1, len(lines)), text.count("http") / n, 0.0,
    ]
    return own + [b / np.sqrt(sum(x * x for x in bins)) for b in bins]


def test_scores_against_brute_force(spark):
    """Features counted one by one and the network unit by unit, for every row, repeated ones and ties included."""
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet")
    docs = docs.unionByName(docs.limit(3)).unionByName(spark.createDataFrame([(9001, None), (9002, " "), (9003, "It's # A | b! http://x 1\n\nb b")], "doc_id long, text string"))
    model = pu.train(docs, labels)
    w1, b1, w2, b2 = model.layers
    rows = docs.collect()
    got = {r["doc_id"]: r for r in pu.score(docs, model).collect()}
    for r in rows:
        x = np.clip((np.array(counted(r["text"] or "")) - model.mean) / model.scale, -8, 8)
        margin = b2[0] + sum(w2[j] * np.tanh(b1[j] + sum(x[i] * w1[i, j] for i in np.flatnonzero(x))) for j in range(len(w2)))
        want = 1 / (1 + np.exp(-margin))
        assert abs(got[r["doc_id"]]["score"] - want) < 1e-5 and got[r["doc_id"]]["predicted"] == int(got[r["doc_id"]]["score"] >= 0.7)


def test_gradient_of_the_risk():
    """One small step of the fit lowers the non-negative risk."""
    rng = np.random.default_rng(2)
    p, u = rng.normal(0.5, 1, (200, pu.N_FEATURES)), rng.normal(0, 1, (400, pu.N_FEATURES))

    def risk(model):
        gp, gu = model.margin(p), model.margin(u)
        return 0.4 * np.logaddexp(0, -gp).mean() + max(0.0, np.logaddexp(0, gu).mean() - 0.4 * np.logaddexp(0, gp).mean())

    few = [pu.fit(p, u, 0.4)]
    start = pu.Model(few[0].mean, few[0].scale, [np.zeros_like(x) for x in few[0].layers], 0.4)
    assert risk(few[0]) < risk(start)
