"""Files that settle in a stream, from the first message of a clock that starts at zero."""

import duckdb

from crateflow.plans import registry


def test_messages_at_the_start_of_the_clock_and_unknown_sizes_count_as_in_sql(spark, tmp_path):
    sizes = {-2: (1, 350.0), 0: (2, 450.0), 1: (3, 250.0), 20: (3, None), 40: (3, 710.0), 41: (4, 120.0), 60: (2, 90.0), 61: (7, None), 80: (7, 330.0), 99: (5, 10.0), 120: (6, 40.0), 140: (None, 900.0)}
    rows = [(i, u, v) for i, (u, v) in sizes.items()] + [(None, 3, 880.0)]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = registry.QUERIES["str01_stream_settled"](spark, str(tmp_path)).select("name", "size", "ready_ms").collect()
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = c.sql(registry.ORACLES["str01_stream_settled"]).select("name", "size", "ready_ms").fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and {("f1.mp3", 3, 940), ("f2.mp3", 4, 1200)} <= set(want)
