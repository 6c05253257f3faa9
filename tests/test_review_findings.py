"""Cases found by review: zero vectors, nothing predicted, many windows, tables that are folders."""

from pyspark.sql import functions as F

from seguelake.functions import vectors
from seguelake.operators import evaluation, series
from seguelake.streaming.feeds import drain, replay


def test_zero_vector_has_no_direction(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<double>")
    assert [r.u for r in df.select(vectors.unit(F.col("v")).alias("u")).collect()] == [None, [0.6, 0.8]]


def test_nothing_predicted(spark):
    df = spark.createDataFrame([(None, 1.0)], "p double, t double")
    assert {(r.coverage, r.rate_evaluated, r.rate_all) for r in evaluation.boundary_metrics(df, "p", "t").collect()} == {(0.0, None, 0.0)}


def test_all_windows_are_ranked(spark):
    rows = [(1, 10.0, float(i), float(i), 100.0, 120.0, 8) for i in range(100)]
    ranked = series.window_role(spark.createDataFrame(rows, "track int, peak double, start double, score double, duration double, bpm double, beats int"))
    assert sorted(r.role_rank for r in ranked.collect()) == list(range(1, 101))


def test_replay_of_a_folder(spark, tmp_path):
    spark.range(30).repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    assert drain(replay(spark, str(tmp_path), "events"), "append").count() == 30


def test_titles(spark):
    from seguelake.functions import titles

    rows = [
        (1, "2019-05-04 - Ann & Bob @ Hall", "open 9:30-12.15"), (2, "Live Ann at Hall", "10pm - 4 am"), (3, "Ann live @ Hall", "12am to 12pm, 1:00-2:00"),
        (4, "Ann @ Live Hall", "3-4"), (5, "", ""), (6, None, None), (7, "Anna and vs", "9:30 9:45 bis 10:15"),
    ]
    t, w = F.col("t"), F.col("w")
    d = spark.createDataFrame(rows, "id int, t string, w string").select(
        "id", titles.set_format(t, F.lit(None).cast("string"), [("vinyl", ("all vinyl",))]).alias("f"), titles.time_range(w).alias("h"), titles.actor_kind(titles.actor(t), F.lit("Ann")).alias("k"),
        titles.labelled(t, [("hall", ("hall", "the hall"))], "none").alias("l"),
    )
    got = {r.id: (r.f, r.h, r.k, r.l) for r in d.collect()}
    assert got == {
        1: ("dj-set", "09:30-12:15", "multi_actor", "hall"), 2: ("", "22:00-04:00", "missing_actor", "hall"), 3: ("live", "00:00-12:00", "missing_actor", "hall"),
        4: ("", "", "missing_actor", "hall"), 5: ("dj-set", "", "missing_actor", "none"), 6: ("dj-set", "", "missing_actor", "none"), 7: ("dj-set", "09:45-10:15", "missing_actor", "none"),
    }
