import hashlib
import random

import numpy as np
import pytest
from voxtide.llm import suffixes as S


def brute(docs, length):
    seen, out = set(), []
    for t in docs:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            w = t[p : p + length]
            if w in seen:
                gone[p : p + length] = True
            seen.add(w)
        out.append(gone)
    return out


def sample(rnd, n):
    alphabet = rnd.choice([b"a", b"ab", b"\0a", bytes(range(256)), b"abcdefgh "])
    base = bytes(rnd.choice(alphabet) for _ in range(300))
    docs = []
    for _ in range(rnd.randint(0, n)):
        t = b""
        for _ in range(rnd.randint(0, 4)):
            a = rnd.randrange(len(base))
            t += base[a : a + rnd.randint(0, 200)] if rnd.random() < 0.6 else bytes(rnd.choice(alphabet) for _ in range(60))
        docs.append(t)
    return docs


@pytest.mark.parametrize("seed", range(40))
def test_windows_against_brute_force(seed, monkeypatch):
    rnd = random.Random(seed)
    length, gram = rnd.choice([(12, 8), (20, 9), (100, 24), (100, 31)])
    monkeypatch.setattr(S, "CHUNK", rnd.choice([64, 256, 1 << 20]))
    docs = sample(rnd, 8)
    size = np.array([len(t) for t in docs], np.int64)
    stop = np.cumsum(size)
    h, t, place, near, far = S.anchors(np.frombuffer(b"".join(docs) or b"\0", np.uint8), stop - size, stop, length, gram)
    assert (far - near + 1).sum() == np.maximum(size - length + 1, 0).sum()
    around = [docs[a][p - f : p - n + length] for a, p, n, f in zip(t.tolist(), place.tolist(), near.tolist(), far.tolist(), strict=True)]
    rank = np.empty(len(t), np.int64)
    rank[np.lexsort((place, t))] = np.arange(len(t))
    removed = S.repeated_windows(np.unique(h, return_inverse=True)[1], rank, near, far, around, length)
    got = [np.zeros(len(x), bool) for x in docs]
    for i, d in zip(*np.nonzero(removed), strict=True):
        got[t[i]][place[i] - d : place[i] - d + length] = True
    assert all((a == b).all() for a, b in zip(got, brute(docs, length), strict=True))


def test_sorting():
    rnd = random.Random(5)
    for _ in range(50):
        s = [bytes(rnd.choice(b"ab\0") for _ in range(rnd.randint(0, 80))) + rnd.choice([b"", b"tail" * 20]) for _ in range(40)]
        group = np.array([rnd.randint(0, 2) for _ in s])
        order, lcp = S.deep_shallow(group, *S._padded(s, 1 + max(map(len, s))))
        assert [(group[i], s[i]) for i in order] == sorted((g, x) for g, x in zip(group, s, strict=True))
        for k in range(1, len(s)):
            a, b = order[k - 1], order[k]
            assert lcp[k] == (S.common(s[a], s[b]) if group[a] == group[b] else -1)


def test_documents(spark):
    rnd = random.Random(9)
    long = "".join(rnd.choice("abcdefgh é") for _ in range(30_000))
    rows = [(3, long[:5000]), (1, long[2000:9000]), (2, None), (4, ""), (7, long[:5000]), (5, "x" * 99), (6, "x" * 99), (8, "x" * 101), (9, long[100:250] + "é" * 80 + long[100:250]), (None, long[8000:8200]), (7, long[:5000]), (10, long)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, row int")
    ranked = sorted({(i is None, i or 0, t or "") for i, t in rows})
    gone = dict(zip(ranked, brute([t.encode() for *_, t in ranked], 100), strict=True))
    want = []
    for i, t in rows:
        data = (t or "").encode()
        g = gone[(i is None, i or 0, t or "")]
        kept = np.frombuffer(data, np.uint8)[~g].tobytes() if data else b""
        want.append((i, len(data), int(g.sum()), int((np.diff(np.concatenate([[0], g.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    for hot in (200_000, 1):
        got = [tuple(r) for r in S.remove_repeats(docs, hot_rows=hot).drop("spans").collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_empty(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert [r["n_removed"] for r in S.remove_repeats(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()] == [0]
