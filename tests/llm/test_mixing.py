import re

import numpy as np
from voxtide.llm import mixing

SCHEMA = "doc_id long, text string, source string, n_chars long, size int, rank int"


def corpus(spark, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, "\t".join(f"w{i}x{k}" for k in range(int(rng.integers(0, 400)))), f"s{i % 7}" if i % 5 else "hot", 1, 0, 0) for i in range(300)]
    rows += [(300, None, "s1", None, 0, 0), (None, "a  b\nc", None, 5, 0, 0), (None, "a  b\nc", None, 5, 0, 0), (5, "one more", "", 1, 0, 0), (301, "z " * 20_000, "s2", 1, 0, 0), (302, None, "empty", 1, 0, 0)]
    return spark.createDataFrame(rows, SCHEMA)


def test_targets_fill_by_weight():
    assert mixing.targets([100, 100, 100], [1, 2, 3]) == [50, 100, 150]
    got = mixing.targets([10, 1000, 1000], [3, 1, 2])
    assert got[0] == 30 and abs(got[1] - 660) < 1e-9 and abs(sum(got) - 2010) < 1e-6
    assert mixing.targets([0, 0], [1, 2]) == [0, 0]
    assert mixing.targets([], []) == []


def test_permutations_are_permutations():
    for n in (1, 2, 3, 7, 64, 1000):
        keys = np.repeat(np.random.default_rng(n).integers(0, 2**63, 4, dtype=np.uint64)[None], n, 0)
        assert sorted(mixing.permuted(np.arange(n), n, keys).tolist()) == list(range(n))


def test_shards_fill_up_and_sum_to_the_totals():
    slots = np.array([1000, 0, 7, 30_000], np.int64)
    parts = [mixing.shard_counts(k, slots, 3, 4096) for k in range(-(-int(slots.sum()) // 4096))]
    assert (sum(now for now, _ in parts) == slots).all()
    assert all(now.sum() == 4096 for now, _ in parts[:-1])
    upto = np.zeros(4, np.int64)
    for now, before in parts:
        assert (before == upto).all()
        upto = upto + now
    few, rng = mixing.LARGE, np.random.default_rng(1)
    for good, bad, n in ((700, 300, 100), (5, 2000, 1000), (3, 4, 6)):
        want = rng.hypergeometric(good, bad, n, 4000)
        mixing.LARGE = 0
        got = np.array([mixing.hypergeometric(good, bad, n, rng) for _ in range(4000)])
        mixing.LARGE = few
        assert abs(got.mean() - want.mean()) < 0.1 * want.std() + 1e-9 and abs(got.std() - want.std()) < 0.1 * want.std() + 1e-9
        assert max(0, n - bad) <= got.min() and got.max() <= min(n, good)
    large = mixing.hypergeometric(10**12, 2 * 10**12, 10**12, rng)
    assert abs(large - 10**12 / 3) < 6 * 4e5
    n = 40_000
    big = mixing.split(np.array([2 * 10**9, 10**9], np.int64), n, [1])
    assert big.sum() == n and abs(big[0] - 2 * n / 3) < 500


def test_report(spark):
    docs = corpus(spark)
    got = mixing.mix_report(docs).toPandas()
    assert len(got) == docs.count()
    pdf = docs.toPandas()
    sizes = pdf.text.map(lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")))
    assert sorted(got["size"]) == sorted(sizes)
    assert (got.taken <= 3 * got["size"]).all()
    names = sorted(pdf.source.dropna().unique()) + [None]
    per = [int(sizes[pdf.source.isna() if s is None else pdf.source == s].sum()) for s in names]
    goal = mixing.targets(per, [i % 3 + 1.0 for i in range(len(names))])
    assert sorted(set(got.target.round(6))) == sorted(set(np.round(goal, 6)))
    for (size, target), part in got.groupby(["source_size", "target"]):
        assert abs(part.taken.sum() - target * per.count(size)) <= max(mixing.BLOCK_WORDS, 0.02 * target) * 1.01
    again = mixing.mix_report(docs.repartition(3)).toPandas()
    key = ["doc_id", "size", "source_size", "target", "taken"]
    assert got[key].sort_values(key).reset_index(drop=True).equals(again[key].sort_values(key).reset_index(drop=True))


def test_mixed_documents_have_the_words_of_the_report(spark):
    docs = corpus(spark)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    got, taken = out.toPandas(), mixing.mix_report(docs).toPandas()
    words = got.text.map(lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t)))
    assert words.sum() == taken.taken.sum()
    by = words.groupby(got.doc_id).sum()
    known = taken[taken.doc_id.notna() & (taken.doc_id != 5) & (taken.taken > 0)].set_index("doc_id").taken
    assert by.drop(5, errors="ignore").to_dict() == known.to_dict()
    original = docs.filter("doc_id = 7").first()["text"]
    assert all(r.text in original for r in got[got.doc_id == 7].itertuples())
    assert (got.n_chars == got.text.str.len()).all()


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert mixing.mix_report(docs).collect() == []
    assert mixing.mixed_documents(docs).collect() == []
    nothing = spark.createDataFrame([(1, None, "a", 0, 0, 0)], SCHEMA)
    assert [tuple(r) for r in mixing.mix_report(nothing).collect()] == [(1, 0, 0, 0.0, 0)]


def test_documents_whose_first_hash_collides_are_told_apart(spark, monkeypatch):
    docs = corpus(spark)
    real = mixing.tie_of
    monkeypatch.setattr(mixing, "tie_of", lambda i, t: mixing.F.struct(mixing.F.lit(0).cast("long").alias("a"), real(i, t)["b"].alias("b")))
    taken = mixing.mix_report(docs).agg({"taken": "sum"}).first()[0]
    mixed = mixing.mixed_documents(docs)
    assert mixed.agg(mixing.F.sum(mixing.n_words(mixing.F.col("text")))).first()[0] == taken
    texts = {(r["doc_id"], r["source"]): r["text"] for r in docs.collect()}
    assert all(r["text"] in texts[r["doc_id"], r["source"]] for r in mixed.collect())


def test_texts_are_cut_once(spark):
    plan = mixing.mixed_documents(corpus(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_cut(") == 1
