import re
from collections import Counter

import pytest
from voxtide.llm import rules


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    covered = {j for i, w in enumerate(windows) if n[w] > 1 for j in range(i, i + 5)}
    solid = "".join(words)
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), len(solid), sum(c in rules.SYMBOLS for c in solid), len(lines) - len(set(lines)), len(covered), failed


TEXTS = [None, "", "a b c d e", "a b c d e a b c d e x", "é # $ | < >\n\nline\nline\n \n\t\n", "w " * 300, "a b c d e f g h i j k " * 2 + "z", "\x0b\x0cq\r\nq\n", "one two three four five six seven eight nine ten " + " ".join(map(str, range(20_000)))]


def test_counts_against_brute_force(spark):
    df = spark.createDataFrame([(i, t, "l", "s", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, kept int")
    got = {r["doc_id"]: r for r in rules.metrics(df).collect()}
    for i, t in enumerate(TEXTS):
        assert tuple(got[i][c] for c in (*rules.BASE, "base_failed")) == brute(t), t


def test_buckets_hold_their_values(spark):
    df = spark.createDataFrame([(v,) for v in [*range(0, 600), 1000, 4095, 4096, 10**6, 10**9]], "v long")
    rows = df.select("v", rules.bucket(df["v"]).cast("long").alias("b")).withColumn("top", rules.bucket_top(rules.F.col("b"))).collect()
    for r in rows:
        assert r["v"] <= r["top"] <= r["v"] + r["v"] / 64
    assert len({r["b"] for r in rows if r["v"] < 128}) == 128


def test_junk_goes_and_clean_text_stays(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().set_index("doc_id")["quality"]
    got = rules.quality_report(docs).toPandas().set_index("doc_id").join(labels, how="inner")
    clean, junk = got[(got.quality == 1) & ~got.base_failed], got[got.quality == 0]
    assert clean.kept.mean() > 0.97
    assert junk.kept.mean() < 0.1


def test_nulls_and_empty(spark):
    schema = "doc_id long, text string, lang string, source string"
    text = " ".join(f"word{i}" for i in range(40))
    df = spark.createDataFrame([(None, text, None, None), (1, text, "en", None), (1, text, "en", None), (2, None, None, "s")], schema)
    got = rules.quality_report(df).collect()
    assert sorted(r["kept"] for r in got) == [False, True, True, True]
    assert rules.adaptive_quality(df).filter("kept").count() == 3
    assert rules.quality_report(spark.createDataFrame([], schema)).collect() == []


def grouped(spark):
    """Two sources: one whose texts differ much in every rule, one whose texts don't; and odd texts in both."""
    rows, n = [], 0
    for source, some in (("wild", 10), ("calm", 0)):
        for i in range(60):
            k = some * (i % 7)
            words = [f"w{i}x{j}" for j in range(800)]
            words[:k] = ["#"] * k  # symbols
            for j in range(k):
                words[100 + j] = words[100 + j].upper()  # capitals
            repeat = [f"r{i}y{j}" for j in range(k * 2 // 3)]
            lines = [" ".join(words[at : at + 20]) for at in range(0, 800, 20)] + [" ".join(repeat)] * 2 + ["same line"] * (some * (i % 4) // 3)
            rows.append((n, "\n".join(x for x in lines if x), "en", source))
            n += 1
        plain = [f"p{j}q" for j in range(400)]
        passage = plain[50:75]
        rows += [
            (1000 + n, " ".join([*plain, *["#"] * 25]), "en", source),
            (2000 + n, "\n".join([*(" ".join(plain[at : at + 20]) for at in range(0, 400, 20)), *["again"] * 6]), "en", source),
            (3000 + n, " ".join([*plain, *passage]), "en", source),
            (4000 + n, " ".join([w.upper() if j < 20 else w for j, w in enumerate(plain)]), "en", source),
        ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_cutoffs_differ_by_source_and_decide_for_every_rule(spark):
    docs = grouped(spark)
    cuts = {r["source"]: r for r in rules.thresholds(rules.sketches(rules.metrics(docs))).collect()}
    for r in rules.RULES:
        assert cuts["wild"][f"cut_{r.name}"] > cuts["calm"][f"cut_{r.name}"] == 0, r.name
    odd = {r["doc_id"]: (r["kept"], r["base_failed"]) for r in rules.quality_report(docs).filter("doc_id >= 1000").collect()}
    assert {k // 1000: v for k, v in odd.items() if k % 1000 == 60} == {k: (True, False) for k in (1, 2, 3, 4)}
    assert {k // 1000: v for k, v in odd.items() if k % 1000 == 120} == {k: (False, False) for k in (1, 2, 3, 4)}
    assert rules.quality_report(docs).filter("doc_id < 1000 and not kept and not base_failed").count() == 0


def test_rows_are_kept_as_they_are(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, text, "en", "s", 777, "x"), (2, None, None, None, 5, None)], "doc_id long, text string, lang string, source string, n_words int, row string")
    assert [tuple(r) for r in rules.kept_documents(df).collect()] == [(1, text, "en", "s", 777, "x")]
    assert rules.kept_documents(df).columns == df.columns


def test_very_long_text(spark):
    rows = [(1, " ".join(f"w{i}" for i in range(200_000)), "en", "s"), (2, "a b c d e f " * 100_000, "en", "s")]
    got = {r["doc_id"]: r for r in rules.quality_report(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got[1]["n_words"] == 200_000 and got[1]["kept"] and got[2]["n_repeat_words"] == 600_000 and got[2]["base_failed"]


@pytest.mark.parametrize("rows", [0, 10])
def test_thresholds_join_both_ways(spark, rows):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(i, text if i % 6 else text.replace(" ", " ### "), "en", f"s{i % 2}") for i in range(30)], "doc_id long, text string, lang string, source string")
    m = rules.metrics(df)
    cuts = rules.materialize(rules.thresholds(rules.sketches(m)), "t")
    assert rules.judge(m, cuts, broadcast_rows=rows).filter("kept").count() == 25
