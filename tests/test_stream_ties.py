"""Stream queries on plays of equal time, against their statements."""

from datetime import datetime, timedelta

import duckdb
import pytest

from seguelake import queries as registry

START = datetime(2024, 1, 1)


@pytest.mark.parametrize("name", ["merged_bursts", "play_history_state"])
def test_equal_times(spark, tmp_path, name):
    registry.load_all()
    kinds = ["view", "purchase", "error", "click"]
    rows = [(i, START + timedelta(minutes=i // 4 * 37 % 3000, seconds=0.5), i % 2, kinds[i % 4]) for i in range(400)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    df = registry.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = con.sql(registry.SQL[name])
    assert df.columns == want.columns
    assert sorted(map(tuple, df.collect())) == sorted(want.fetchall())
    if name == "play_history_state":
        assert "last" in df.columns
