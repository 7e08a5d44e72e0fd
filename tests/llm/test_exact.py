import hashlib

from pyspark.sql import functions as F
from voxtide.llm import exact

ROWS = [(1, "a"), (2, "a"), (3, "b"), (4, None), (5, ""), (5, ""), (None, "c"), (6, "c"), (None, "d"), (None, "d"), (7, "x" * 50_000), (8, "x" * 50_000)]


def frame(spark, rows):
    # columns that an implementation might use itself
    return spark.createDataFrame([(i, t, 0, "k") for i, t in rows], "doc_id long, text string, n int, h string")


def brute(rows, keep):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = (min if keep == "min" else max)(known) if known else None
        done = False
        for i in ids:
            kept = i == best and not done
            done |= kept
            out.append((i, best, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    for keep, most in (("min", 500_000), ("max", 500_000), ("max", 0)):
        assert sorted(map(tuple, exact.exact_dedup(frame(spark, ROWS), keep=keep, broadcast_rows=most).collect()), key=str) == brute(ROWS, keep)


def test_collisions_are_told_apart_by_bytes(spark, monkeypatch):
    weak = lambda t: F.unhex(F.lpad(F.hex(F.length(t)), 4, "0"))
    rows = [(1, "ab"), (2, "cd"), (3, "ab"), (4, "xyz"), (5, "cd"), (6, "q")]
    for most, hot in ((500_000, 100_000), (0, 100_000), (0, 2)):
        monkeypatch.setattr(exact, "HOT_GROUPS", hot)
        assert sorted(map(tuple, exact.exact_dedup(frame(spark, rows), hash_of=weak, broadcast_rows=most).collect()), key=str) == brute(rows, "min")


def test_of_repeated_rows_a_fixed_one_stays(spark):
    rows = [(1, "a", 5), (1, "a", 3), (1, "a", None), (2, "a", 0)]
    for order in (rows, rows[::-1]):
        got = exact.drop_exact_duplicates(spark.createDataFrame(order, "doc_id long, text string, c int").repartition(3))
        assert list(map(tuple, got.collect())) == [(1, "a", 3)]


def test_empty(spark):
    assert exact.exact_dedup(frame(spark, [])).collect() == []
    assert exact.drop_exact_duplicates(frame(spark, [])).columns == ["doc_id", "text", "n", "h"]


def test_drop_keeps_one_row_of_each_text(spark):
    got = exact.drop_exact_duplicates(frame(spark, ROWS))
    assert got.columns == ["doc_id", "text", "n", "h"]
    rows = got.collect()
    assert sorted((r["text"] or "")[:3] for r in rows) == ["", "a", "b", "c", "d", "xxx"]
    assert {r["doc_id"] for r in rows} == {1, 3, 4, 6, None, 7}


def test_groups_join_both_ways(spark, monkeypatch):
    rows = [(i, f"text {i % 7}" if i % 3 else "hot") for i in range(120)] + [(200 + i, f"lone {i}") for i in range(5)]
    weak = lambda t: F.unhex(F.lpad(F.hex(F.length(t)), 4, "0"))
    for hash_of in (exact.content_hash, weak):
        for most, hot in ((500_000, 100_000), (0, 100_000), (0, 2), (0, 6)):
            monkeypatch.setattr(exact, "HOT_GROUPS", hot)
            got = exact.drop_exact_duplicates(frame(spark, rows), hash_of=hash_of, broadcast_rows=most)
            assert sorted(r["doc_id"] for r in got.collect()) == sorted(r[0] for r in brute(rows, "min") if r[3])
            assert sorted(map(tuple, exact.exact_dedup(frame(spark, rows), hash_of=hash_of, broadcast_rows=most).collect()), key=str) == brute(rows, "min")
