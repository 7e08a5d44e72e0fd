import itertools
import re

import numpy as np
from voxtide.llm import audit

SCHEMA = "doc_id long, text string, lang string, n int, mask long, first string"
MANY = " ".join(f"w{i}" for i in range(210))
TEXTS = [None, "", MANY, MANY + " #", MANY.upper(), "a " * 300, "A " * 300 + "|", "few words", "few words", MANY, "é" * 50 + " Ab", "\x0b \x0c\r\n", "x" * 100_000 + " " + MANY]


def docs_of(n=120):
    rows = [((i * 7) % 90 if i % 11 else None, TEXTS[(i * i) % len(TEXTS)], [None, "", "en", "de"][i % 4]) for i in range(n)]
    return [*rows, rows[5], rows[5], (1000, "only here", "fr")]


def labels_of():
    return [(i, i % 3 == 0, i % 5 == 0) for i in range(0, 90, 2)] + [(4, None, True), (4, True, None), (None, True, True), (5000, True, True)]


def brute(docs, labels):
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good, toxic = {i for i, q, _ in labels if q}, {i for i, _, x in labels if x}
    rows = []
    for i, t, lang in docs:
        t = t or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(ws) < 200,
            "B": 100 * len(set(ws)) < 50 * len(ws),
            "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and i > first[t],
        }
        rows.append((lang or "", {x for x, v in fails.items() if v}, i is not None and i in good, i is not None and i in toxic))
    out = []
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        total = dict.fromkeys(audit.LETTERS, 0)
        found = []
        for order in map("".join, itertools.permutations(audit.LETTERS)):
            for step in range(1, 6):
                own, before = order[step - 1], set(order[: step - 1])
                gone = [bool(r[1] & before) for r in mine]
                out_now = [own in r[1] and not g for r, g in zip(mine, gone)]
                total[own] += sum(out_now)
                kept = sum(own not in r[1] and not g for r, g in zip(mine, gone))
                redundant = sum(own in r[1] and g for r, g in zip(mine, gone))
                alone = sum(r[1] == {own} for r in mine)
                found.append((part, order, step, kept, sum(out_now), redundant, alone, sum(x and r[2] for r, x in zip(mine, out_now)), sum(x and r[3] for r, x in zip(mine, out_now))))
        out += [(*r, total[r[1][r[2] - 1]]) for r in found]
    return sorted(out)


def run(spark, docs, labels):
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in docs], SCHEMA)
    return audit.audit_filters(df, spark.createDataFrame([(i, None if q is None else int(q), None if t is None else int(t), 9) for i, q, t in labels], "doc_id long, quality int, toxic int, n int"))


def test_against_brute_force(spark):
    docs, labels = docs_of(), labels_of()
    got = run(spark, docs, labels)
    assert got.columns == [c.split()[0] for c in audit.SCHEMA.split(", ")]
    assert sorted(map(tuple, got.collect())) == brute(docs, labels)


def test_empty_tables(spark):
    assert run(spark, [], labels_of()).collect() == []
    assert sorted(map(tuple, run(spark, docs_of(30), []).collect())) == brute(docs_of(30), [])


def test_more_parts_than_a_batch_of_matrices(spark):
    docs = [(i, TEXTS[i % len(TEXTS)], f"l{i % 150}") for i in range(300)]
    got = run(spark, docs, labels_of())
    assert got.count() == 150 * 600
    assert sorted(map(tuple, got.filter("part = 'l149'").collect())) == [r for r in brute(docs, labels_of()) if r[0] == "l149"]


def test_every_mask_has_one_outcome_of_each_kind():
    m = audit.outcome_matrices()
    assert {x.shape for x in m.values()} == {(32, 600)} and {x.dtype for x in m.values()} == {np.dtype(np.int64)}
    last = np.array([step == 5 for _, step in audit.STEPS])
    for mask in range(32):
        removed = m["removed"][mask].reshape(120, 5).sum(1)
        assert (removed == (mask > 0)).all() and (m["kept"][mask][last] == (mask == 0)).all()
