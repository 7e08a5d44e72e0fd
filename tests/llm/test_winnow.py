import hashlib
import random
import re

import pytest
from voxtide.llm import winnow

SCHEMA = "doc_id long, text string, w string, h long, item string"
UP = str.maketrans(winnow.UPPER, winnow.LOWER)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UP))


def brute(docs, items):
    windows = {}
    for item, text in items:
        ws = words(text)
        m = min(10, len(ws))
        for i in range(len(ws) - m + 1 if m else 0):
            windows.setdefault(tuple(ws[i : i + m]), set()).add("" if item is None else str(item))
    out = []
    for i, text in docs:
        ws, hit, found = words(text), set(), set()
        for m in {len(k) for k in windows}:
            for at in range(len(ws) - m + 1):
                if k := windows.get(tuple(ws[at : at + m])):
                    hit |= set(range(at, at + m))
                    found |= k
        out.append((i, len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def frames(spark, docs, items):
    return spark.createDataFrame([(i, t, "w", 1, "x") for i, t in docs], SCHEMA), spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, least int")


def made(seed, letters=6, n_docs=60):
    """Random texts of few words, so that grams repeat and ties are common, with passages of items put in."""
    r = random.Random(seed)
    some = lambda n: [r.choice("aBcdeé"[:letters]) * r.randint(1, 2) for _ in range(n)]
    items = [(i, " ".join(some(n))) for i, n in enumerate([0, 1, 3, 3, 7, 9, 10, 11, 14, 40, 300])]
    docs = []
    for i in range(n_docs):
        text = some(r.choice([0, 1, 5, 12, 60, 255, 256, 270, 700]))
        for _ in range(r.randint(0, 3)):
            ws = r.choice(items[6:])[1].split()
            a = r.randrange(len(ws))
            at = r.randint(0, len(text))
            text[at:at] = ws[a : a + r.choice([4, 9, 10, 11, 30])]
        docs.append((i, r.choice([" ", ", ", "\n-\t"]).join(text)))
    return docs, items


@pytest.mark.parametrize(("seed", "most"), [(1, 500_000), (2, 0)])
def test_against_brute_force(spark, seed, most):
    docs, items = made(seed)
    docs += [(7, docs[7][1]), (None, docs[9][1]), (70, docs[9][1]), (71, None), (72, ""), (73, "!!")]
    items += [(5, "z y x"), (None, "q r s t u v w x y zz k"), (90, None), (91, "?!")]
    docs += [(80, "Q r, s T u v w x y ZZ k"), (81, "q r s t u v w x y"), (82, "z? Y! X")]
    got = winnow.contamination(*frames(spark, docs, items), broadcast_rows=most)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items)


def test_many_words_and_long_items_only(spark):
    docs, items = made(3, n_docs=40)
    items = items[6:]
    assert sorted(map(tuple, winnow.contamination(*frames(spark, docs, items)).collect()), key=str) == brute(docs, items)


def test_only_commonest_texts_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(winnow, "HOT_TEXTS", 2)
    docs, items = made(4, n_docs=20)
    docs += [(100 + i, docs[3][1] + " " + items[9][1]) for i in range(60)]
    assert sorted(map(tuple, winnow.contamination(*frames(spark, docs, items), broadcast_rows=0).collect()), key=str) == brute(docs, items)


def test_very_long_text(spark):
    r = random.Random(5)
    item = [f"i{k}" for k in range(30)]
    text = [f"w{r.randrange(5000)}" for _ in range(200_000)]
    text[50_000:50_000] = item[3:20]
    text += item[:10]
    docs = [(1, " ".join(text)), (2, " ".join(item * 2000))]
    assert sorted(map(tuple, winnow.contamination(*frames(spark, docs, [(1, " ".join(item))])).collect()), key=str) == brute(docs, [(1, " ".join(item))])


def test_empty_tables(spark):
    docs, items = made(6, n_docs=5)
    assert winnow.contamination(*frames(spark, [], items)).collect() == []
    for few in ([], [(1, None)]):
        assert sorted(map(tuple, winnow.contamination(*frames(spark, docs, few)).collect()), key=str) == brute(docs, few)


def test_clean_rows_stay_as_they_are(spark):
    docs, items = made(7)
    items = items[6:]
    df, it = frames(spark, docs, items)
    got = winnow.decontaminated(df, it)
    assert got.columns == df.columns
    clean = {r[0] for r in brute(docs, items) if not r[-1]}
    assert sorted((r["doc_id"], r["text"], r["w"], r["h"], r["item"]) for r in got.collect()) == sorted((i, t, "w", 1, "x") for i, t in docs if i in clean)


def test_no_python_workers(spark, sf):
    df = winnow.contamination(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"))
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
