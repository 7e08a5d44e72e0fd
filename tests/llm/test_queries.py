from pathlib import Path

import duckdb
import pytest
from voxtide.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    rel = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(rel.columns)
    want = sorted(map(str, rel.fetchall()))
    assert sorted(str(tuple(r[c] for c in rel.columns)) for r in got.collect()) == want
