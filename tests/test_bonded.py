"""Distance joins whose tables look small, and days of events as SQL has them."""

import datetime as dt

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from voxtide.operators import joins
from voxtide.plans import catalog


def test_sent_rows_are_not_broadcast(spark):
    a = spark.createDataFrame([(0, i, float(i), float(-i), i * 0.5) for i in range(40)], "frame int, part int, x double, y double, z double")
    made = joins.distance_join(a, a, 1.5, on=("frame",))
    assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["part"], r["part_2"]) for r in made.collect()) == sorted((i, j) for i in range(40) for j in (i - 1, i, i + 1) if 0 <= j < 40 and 2.25 * (i - j) ** 2 < 2.25 or i == j)


@pytest.mark.parametrize("radius", [0.1, 2.0, 7.5])
def test_pairs_on_cell_edges(spark, radius):
    at = [k * radius * 0.5 for k in range(-9, 10)] + [1e9, 1e9 + radius * 0.999]
    a = spark.createDataFrame([(i, x) for i, x in enumerate(at)], "i int, x double")
    want = sorted((i, j) for i, p in enumerate(at) for j, q in enumerate(at) if (p - q) ** 2 < radius * radius)
    assert sorted((r["i"], r["i_2"]) for r in joins.distance_join(a, a, radius, ("x",)).collect()) == want


@pytest.mark.parametrize("name", ["usable_particles", "point_cloud_index", "track_renumber", "track_speed", "track_extents"])
def test_last_half_second_of_a_day(spark, tmp_path, name):
    times = [dt.datetime(2024, 1, 1, 23, 59, s, us) for s, us in ((59, 400000), (59, 500000), (59, 999999), (58, 500000))] + [dt.datetime(1969, 12, 30, 7), dt.datetime(1969, 12, 31, 12), dt.datetime(1970, 1, 1)]
    rows = {"event_id": list(range(7, 14)), "ts": pa.array(times, pa.timestamp("us")), "user_id": [1, 1, 1, 1, 2, 2, 3], "event_type": ["a"] * 7, "value": [float(i * i) for i in range(1, 8)], "props": ['{"k": 3}'] * 7}
    pq.write_table(pa.table(rows), tmp_path / "events.parquet")
    got = catalog.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog.ORACLES[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
