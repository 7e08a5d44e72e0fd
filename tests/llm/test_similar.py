import random
import sys
from pathlib import Path

import pytest
from voxtide.llm import similar

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402


def sets(text):
    words = (text or "").encode().lower().split()
    k = min(5, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else {()}


def kept(rows):
    """The least id of each group by comparing all pairs."""
    rows = sorted(rows)
    s, group = [sets(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and 5 * len(s[i] & s[j]) >= 4 * len(s[i] | s[j]):
                lo, hi = sorted((group[i], group[j]))
                group = [lo if g == hi else g for g in group]
    return [rows[g][0] for g in sorted(set(group))]


def edited(text, n, draw):
    words = text.split()
    for i in draw.sample(range(len(words)), n):
        words[i] = f"new{draw.random()}"
    return " ".join(words)


def made():
    draw = random.Random(5)
    base = [" ".join(draw.choice("abcdefghijklm") + str(draw.randrange(40)) for _ in range(n)) for n in (120, 200, 300, 60)]
    rows = [*base, *[edited(base[0], draw.randrange(1, 5), draw) for _ in range(90)], *[edited(base[1], k, draw) for k in (1, 3, 4, 6, 12, 20)]]
    rows += [edited(base[2], k, draw) for k in (1, 5, 9, 30)] + [None, "", "One", "one ", "one two", "a b c d e", "A b c d e"]
    return list(enumerate(rows))


@pytest.mark.parametrize("pairwise", [2, 32])
def test_edited_copies_against_all_pairs(spark, monkeypatch, pairwise):
    monkeypatch.setattr(similar.links, "__defaults__", (*similar.links.__defaults__[:2], pairwise))
    rows = made()
    out = corpus_pipeline.dedup_near(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r["doc_id"] for r in out.collect()) == kept([(i, t or "") for i, t in rows])


def test_prefix_pairs_lose_no_similar_pair(spark):
    """Of copies that are similar to others in every degree, all pairs across components that are similar enough are among the candidates."""
    draw = random.Random(3)
    base = [[f"b{k}w{i}" for i in range(80)] for k in range(2)]
    texts = []
    for i in range(120):
        words = list(draw.choice(base))
        for at in draw.sample(range(80), draw.randrange(0, 5)):
            words[at] = f"e{i}" if draw.random() < 0.7 else f"shared{at}"
        texts.append(words[draw.randrange(0, 8) : 80 - draw.randrange(0, 8)])
    made = [similar.shingles(" ".join(t).encode()) for t in texts]
    sets_ = spark.createDataFrame([(i, [int(v) for v in m.view("int64")]) for i, m in enumerate(made)], "x long, s array<long>")
    groups = [i % 7 if i % 3 else 0 for i in range(120)]
    members = spark.createDataFrame([(i, c) for i, c in enumerate(groups)], "x long, c long")
    got = {(r["src"], r["dst"]) for r in similar.prefix_pairs(members, sets_, 0.8).collect()}
    s = [set(m.tolist()) for m in made]
    want = {(i, j) for j in range(120) for i in range(j) if groups[i] != groups[j] and 5 * len(s[i] & s[j]) >= 4 * len(s[i] | s[j])}
    assert want <= got and len(want) > 50 and len(got) < 120 * 119 / 2


def test_every_pair_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = kept([(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()])
    assert sorted(r["doc_id"] for r in similar.drop_similar(docs).collect()) == want


def test_repeats_and_nulls(spark):
    rows = [(3, "a b c d e f g", 1), (1, "A b c d e f g", 1), (2, "other words than these here", 1), (2, "other words than these here", 1), (4, None, 1), (5, "", 1), (None, "zz", 1)]
    out = similar.drop_similar(spark.createDataFrame(rows, "doc_id long, text string, c int"))
    assert out.columns == ["doc_id", "text", "c"]
    assert sorted((r["doc_id"] or 0) for r in out.collect()) == [0, 1, 2, 4]
    assert similar.drop_similar(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_recall_near_the_bound(spark):
    """Of 400 pairs at a similarity between 0.8 and 0.95, all are found."""
    draw = random.Random(9)
    rows = []
    for i in range(400):
        base = " ".join(f"t{i}w{draw.randrange(10**6)}" for _ in range(draw.randrange(100, 400)))
        rows.append((2 * i, base))
        rows.append((2 * i + 1, edited(base, max(1, len(base.split()) // draw.choice([46, 60, 100])), draw)))
    near = [i for i in range(400) if 5 * len(sets(rows[2 * i][1]) & sets(rows[2 * i + 1][1])) >= 4 * len(sets(rows[2 * i][1]) | sets(rows[2 * i + 1][1]))]
    assert len(near) > 350
    left = {r["doc_id"] for r in similar.drop_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {2 * i for i in range(400)} <= left
    assert sum(2 * i + 1 not in left for i in near) >= 0.999 * len(near)
    assert all(2 * i + 1 in left for i in range(400) if i not in near)
