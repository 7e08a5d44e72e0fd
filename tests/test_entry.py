import importlib.util
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def entry():
    spec = importlib.util.spec_from_file_location("__spark_entry__", ROOT / "__spark_entry__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def test_flagship(spark, entry):
    assert entry.entry(spark).count() > 0


def test_every_query_that_sql_can_express(spark, entry, con):
    from jobs import queries as jobs
    from voxtide.plans import catalog

    wrong = []
    for name, sql in (catalog.ORACLES | jobs.ORACLES).items():
        df = (catalog.QUERIES | jobs.QUERIES)[name](spark, SF)
        rel = con.sql(sql)
        got = sorted((tuple(r[c] for c in rel.columns) for r in df.collect()), key=repr)
        want = sorted(rel.fetchall(), key=repr)
        if sorted(df.columns) != sorted(rel.columns) or len(got) != len(want) or any(repr(_plain(a)) != repr(_plain(b)) for a, b in zip(sorted(map(_plain, got)), sorted(map(_plain, want)), strict=True)):
            wrong.append(name)
    assert not wrong


def _plain(row):
    return tuple("" if v is None else f"{float(v):.9g}" if isinstance(v, int | float) and not isinstance(v, bool) else str(v) for v in row)


def test_other_queries_give_rows(spark, entry):
    from voxtide.plans import catalog

    for name in catalog.QUERIES.keys() - catalog.ORACLES.keys():
        assert catalog.QUERIES[name](spark, SF).count() > 0, name
