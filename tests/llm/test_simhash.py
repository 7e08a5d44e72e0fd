import re

import numpy as np
import pytest
import xxhash
from voxtide.llm import simhash


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    k = min(3, len(words))
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(fps, most=2):
    parent = list(range(len(fps)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= most):
            parent[find(i + 1 + int(j))] = find(i)
    return [find(i) for i in range(len(fps))]


TEXTS = [None, "", " \n", "One", "one two", "ONE two three", "É a b c", "a  b\tc\x0bd\ne", "x " * 5000, " ".join(map(str, range(20_000)))]


def test_fingerprints():
    for t in TEXTS:
        assert simhash.fingerprint((t or "").encode()) == plain(t)


def test_components_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(5000 + i, t) for i, t in enumerate(TEXTS)] + [(None, "One"), (5003, "One")], "doc_id long, text string")
    got = simhash.near_duplicates(docs.unionByName(odd).withColumn("fp", docs["text"])).toPandas()
    texts = docs.unionByName(odd).toPandas()
    assert len(got) == len(texts)
    fps = np.array([int(x, 16) for x in got.fingerprint], np.uint64)
    assert sorted(fps.tolist()) == sorted(plain(t) for t in texts.text)
    group = got.assign(c=components(fps))
    for _, part in group.groupby("c"):
        assert part.component_id.nunique() == 1 and part.component_id.iloc[0] == part.doc_id.min()
    assert group.c.nunique() == group.component_id.nunique()


def linked(fps, links):
    at, label, moved = {int(x): i for i, x in enumerate(fps)}, list(range(len(fps))), True
    while moved:
        moved = False
        for a, b in links:
            low = min(label[at[a]], label[at[b]])
            moved |= label[at[a]] != low or label[at[b]] != low
            label[at[a]] = label[at[b]] = low
    return label


@pytest.mark.parametrize(("max_bits", "pairwise"), [(0, 32), (1, 1), (2, 1), (2, 4), (2, 1000), (3, 2), (4, 8), (4, 1000)])
def test_links_against_all_pairs(spark, max_bits, pairwise):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 4, dtype=np.uint64)
    near = [b ^ np.uint64(sum(1 << int(k) for k in rng.integers(0, 64, rng.integers(0, 2 + max_bits)))) for b in base for _ in range(60)]
    fps = np.unique(np.array([*near, *rng.integers(0, 2**64, 100, dtype=np.uint64), 0, 1, 2**63], np.uint64))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    got = [(int(r["src"]) % 2**64, int(r["dst"]) % 2**64) for r in simhash.links(df, max_bits, pairwise=pairwise).collect()]
    assert all((a ^ b).bit_count() <= max_bits for a, b in got)
    label, want = linked(fps, got), components(fps, max_bits)
    assert len(set(label)) == len(set(want)) == len(set(zip(label, want, strict=True)))


def test_distances_make_candidates_and_bound_bits(spark):
    """Fingerprints that agree in a segment agree in its distances, few others do, and coordinates differ by no more than bits."""
    rng = np.random.default_rng(4)
    fps = rng.integers(-(2**63), 2**63 - 1, 3000, dtype=np.int64)
    rows = simhash.pivot_table(spark.createDataFrame([(int(x),) for x in fps], "fp long")).collect()
    cut = simhash.segments(2)
    for s, bits in enumerate(cut):
        own = {(int(r["fp"]) >> bits[0]) & 0xFFFF for r in rows}
        assert 0.97 * len(own) <= len({r["near"][s] for r in rows}) <= len(own)
    refs = [x % 2**64 for x in simhash.references()]
    assert all(r["far"] == [((int(r["fp"]) % 2**64) ^ x).bit_count() for x in refs] for r in rows[:50])


def test_of_repeated_rows_a_fixed_one_stays(spark):
    rows = [(1, "a b c d", 5), (1, "a b c d", 3), (1, "a b c d", None), (2, "x", 1)]
    for order in (rows, rows[::-1]):
        out = simhash.drop_near_duplicates(spark.createDataFrame(order, "doc_id long, text string, c int").repartition(3))
        assert sorted(map(tuple, out.collect())) == [(1, "a b c d", 3), (2, "x", 1)]


def test_drop(spark):
    rows = [(3, "a b c d e f g"), (1, "A b c d e f g"), (2, "other words than these here"), (2, "other words than these here"), (4, None), (5, ""), (None, "zz")]
    out = simhash.drop_near_duplicates(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, c int"))
    assert out.columns == ["doc_id", "text", "c"]
    assert sorted((r["doc_id"] or 0) for r in out.collect()) == [0, 1, 2, 4]
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
