import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer
from voxtide.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["KİTABİ. ENDİ, SON Sİ? İ! ²İ. aİ²: x²İ;", "It's don't we're '' 'S x's. <|endoftext|> a<|startoftext|>b.! |.|", "Ünï É. ÇA! Σας ΟΔΟΣ. ﬁ x́. é, Ω. a\xa0b. c  d\x1ce. 1.2.3 ... !!! . ,", "日本語。テスト. ½. ²x² a_b_c. __ ‍. ́ ́.", "", "   ", "\x0b\x0c", None, "q" * 30_000, "the cat, " * 9000]


def test_ids_are_the_tokenizers():
    t, w = Tokenizer.from_file(PATH), packing.Words(PATH)
    texts = [x or "" for x in ODD]
    for text, ids in zip(texts, w.ids(pa.array(texts)), strict=True):
        assert ids.tolist() == [*t.encode(text, add_special_tokens=False).ids, 2]


def test_each_id_is_in_one_piece(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(ODD)] + [(None, "x")], "doc_id long, text string")
    docs = docs.unionByName(odd)
    got = packing.pack(docs.withColumn("length", docs["text"]), PATH, with_ids=True).toPandas()
    t = Tokenizer.from_file(PATH)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for key, part in got.groupby("doc_id", dropna=False):
        ids = [*t.encode(texts[None if key != key else int(key)], add_special_tokens=False).ids, 2]
        assert (part.doc_tokens == len(ids)).all()
        at = 0
        for r in part.sort_values("start").itertuples():
            assert r.start == at and r.length == len(r.ids) and list(r.ids) == ids[at : at + r.length]
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for _, part in got.groupby("sequence_id"):
        assert (part.sort_values("offset").offset.to_numpy() == np.concatenate([[0], part.sort_values("offset").length.cumsum().to_numpy()[:-1]])).all()
        assert part.length.sum() == part.sequence_length.iloc[0] <= 4096
    assert packing.padding(got.groupby("sequence_id").length.sum()) == 0


@pytest.mark.parametrize("seed", range(5))
def test_level_has_the_least_sum_of_squares(seed):
    rng = np.random.default_rng(seed)
    p = packing.Packer(32)
    for _ in range(300):
        size = int(rng.integers(1, 32))
        n = p.levels.copy()
        costs = {}
        for h in range(0, 33 - size):
            if h == 0 or n[h]:
                m = n.copy()
                m[h] -= h > 0
                if h + size < 32:
                    m[h + size] += 1
                costs[h] = int((m[1:32] ** 2).sum())
        level = p.level_for(size)
        assert costs[level] == min(costs.values())
        p.add(0, np.zeros(size, np.uint32))
    total = sum(len(x[2]) for x in p.out) + sum(len(q[2]) for level in p.open for w in level for q in w)
    p.finish()
    assert sum(len(x[2]) for x in p.out) == total
    lengths = {}
    for x in p.out:
        lengths[x[4]] = lengths.get(x[4], 0) + len(x[2])
    assert all(v <= 32 and (v & (v - 1)) == 0 for v in lengths.values())


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_ids_of_random_strings(monkeypatch):
    """Words of any letters, marks, digits and signs, with a cache that starts anew again and again."""
    monkeypatch.setattr(packing, "CACHE_BYTES", 1 << 20)
    rng = np.random.default_rng(2)
    letters = list("abcXYZéÉßİıŞĞΣςΩДжאबकि語テǅﬁªº")
    signs = list(".,;:!?'\"<>|()-#*0123²½_\u0301\u0307\u200d\xa0")
    draw = lambda pool, n: "".join(rng.choice(pool, n))
    words = [draw(letters, rng.integers(1, 7)) + (draw(signs, rng.integers(0, 4)) if rng.random() < 0.6 else "") + (draw(letters, rng.integers(0, 3)) if rng.random() < 0.3 else "") for _ in range(40_000)]
    texts = [" ".join(words[i : i + 5]) for i in range(0, len(words), 5)]
    t, w = Tokenizer.from_file(PATH), packing.Words(PATH)
    wrong = []
    for lo in range(0, len(texts), 500):
        part = texts[lo : lo + 500]
        for text, ids, want in zip(part, w.ids(pa.array(part)), t.encode_batch(part, add_special_tokens=False), strict=True):
            if ids.tolist() != [*want.ids, 2]:
                wrong.append(text)
        assert w.bytes < 4 << 20
    assert not wrong, wrong[:5]
