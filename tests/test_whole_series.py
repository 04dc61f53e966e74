"""Matrices of whole tracks, colours by hashing, and streams of tables that are folders."""

import numpy as np
from pyspark.sql import functions as F

from crateflow.operators import matching, series, signals
from crateflow.plans import registry


def test_a_table_that_is_a_folder_streams_as_a_file_does(spark, tmp_path):
    e = spark.range(400).select(F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts"), (F.col("id") % 7).alias("user_id"), F.lit("view").alias("event_type"), (F.col("id") % 40 * 5.0).alias("value"), F.lit("{}").alias("props"))
    e.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    got = registry.QUERIES["str01_stream_settled"](spark, str(tmp_path))
    assert sorted(r.name for r in got.collect()) == [f"f{k}.mp3" for k in range(1, 7) if k != 5]


def test_centred_matrix_is_that_of_the_whole_track(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 6))
    spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.track, r.i, r.j): r.c for r in registry.QUERIES["sig14_double_centred"](spark, str(tmp_path)).collect()}
    want = {}
    for t in (0, 1):
        s = x[t::2] @ x[t::2].T
        c = s - s.mean(1, keepdims=True) - s.mean(0, keepdims=True) + s.mean()
        want |= {(t, i, j): c[i, j] for i in range(75) for j in range(75)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    frames = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(x[::2])], "track int, idx int, embedding array<double>")
    assert {(r.track, r.i, r.j): r.c for r in series.double_centred(frames, 7).collect()} == {k: v for k, v in got.items() if k[0] == 0}


def test_colours_are_compared_without_sorting(spark):
    palette = spark.createDataFrame([(-3, 0, 0, 0), (7, 0, 0, 0), (2, 255, 255, 255)], "code int, r int, g int, b int")
    colors = spark.createDataFrame([(1, 0, 0, 1), (2, 250, 250, 250), (2, 255, 255, 255), (3, 9, 9, 9), (4, None, 1, 1)], "id long, r int, g int, b int")
    got = matching.nearest_color(colors, palette)
    assert {r.id: r.code for r in got.collect()} == {1: -3, 2: 2, 3: -3, 4: -3}
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()


def test_blocks_of_signs_are_full_but_for_the_last(spark):
    rng = np.random.default_rng(1)
    v = spark.createDataFrame([(i * 3, [int(b) for b in rng.choice([-1, 1], 12)]) for i in range(60)], "vec_id long, bits array<int>")
    found = signals.similar_signs(v.where("vec_id % 5 = 0"), v.where("vec_id % 5 <> 0"), 8, 0.75, block=20)
    assert found.count() > 0
    assert "pmod" not in found._jdf.queryExecution().analyzed().toString()  # not dealt by a hash into parts of a few rows each
