import importlib.util
import re
import sys
from pathlib import Path

import numpy as np
from test_rules import brute as counts
from test_similar import kept as unlike
from voxtide.llm import mixing, rules

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def test_stages_against_brute_force(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs, seen = src, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "/root/testdata/sf0.001")
        out.write.parquet(str(tmp_path / str(i)))
        seen.append((name, docs.toPandas(), spark.read.parquet(str(tmp_path / str(i)))))
        docs = seen[-1][2]
    (_, before, quality), (_, rated, exact), (_, unique, near), (_, few, mixed), (_, blocks, packed) = seen
    for kept in (quality, exact, near, mixed):
        assert kept.columns == src.columns
    passed = {r.doc_id for r in before.itertuples() if not counts(r.text)[-1]}
    kept = set(quality.toPandas().doc_id)
    report = rules.quality_report(src).toPandas()
    assert kept == set(report[report.kept].doc_id) and kept <= passed and len(kept) > 0.8 * len(passed)
    assert set(exact.toPandas().doc_id) == set(rated.groupby("text").doc_id.min())
    assert sorted(near.toPandas().doc_id) == unlike([(r.doc_id, r.text or "") for r in unique.itertuples()])
    sizes = few.text.map(words).groupby(few.source).sum().sort_index()
    goal = mixing.targets(sizes.tolist(), [i % 3 + 1.0 for i in range(len(sizes))])
    taken = mixed.toPandas()
    got = taken.text.map(words).groupby(taken.source).sum().reindex(sizes.index, fill_value=0)
    assert (np.abs(got - goal) <= np.maximum(mixing.BLOCK_WORDS, 0.03 * np.array(goal))).all()
    pieces = packed.toPandas()
    assert pieces.groupby("sequence_id").length.sum().max() <= 4096
    ends = pieces.groupby("doc_id").length.sum()
    assert set(ends.index) == set(taken.doc_id)


def test_run_and_registration(spark):
    spec = importlib.util.spec_from_file_location("__spark_entry__", Path(corpus_pipeline.__file__).with_name("__spark_entry__.py"))
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    names = list(entry.queries())
    assert [next(n for n in names if n.startswith(f"op{k}_")) for k in range(1, 11)] and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


def test_odd_rows_and_columns(spark):
    """Nulls in every column, repeats, empty and long texts, and columns named like those that stages make."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_words int, row string, id int, x int, component string, kept boolean"
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{text} {i} " + " ".join(f"y{i}z{j}" for j in range(30)), "en", f"s{i % 3}", 9, 777, "r", 1, 2, "c", False) for i in range(20)]
    rows += [rows[0], rows[0], (50, rows[1][1], None, None, None, None, None, None, None, None, None), (None, text, "en", None, 1, 1, "", 0, 0, "", True)]
    rows += [(None,) * 11, (60, "", "en", "s1", 0, 0, "", 0, 0, "", True), (61, " ".join(f"l{i}" for i in range(50_000)), "en", "s1", 0, 0, "", 0, 0, "", True)]
    docs = spark.createDataFrame(rows, schema)
    for docs in (docs, docs.limit(0)):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, "")
            if i < 4:
                assert out.columns == docs.columns
                docs = corpus_pipeline.materialized(out, i)
            if i == 2:
                seen = docs.collect()
                assert {r["doc_id"] for r in seen if r["doc_id"] is not None} <= set(range(20)) | {61}
                assert all(r["n_words"] in (777, 1, 0) for r in seen)
        assert out.count() >= 0 if docs.isEmpty() else out.count() > 0
