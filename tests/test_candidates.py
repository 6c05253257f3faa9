"""Candidate pairs are never shuffled, and cutting batches keeps the first rows of every group."""

import random

from pyspark.sql import functions as F

from seguelake import grouping
from seguelake.operators import pairs


def tables(spark):
    draw = random.Random(3)
    pool = [(i, "s%d" % (i % 2), float(draw.choice([0, 60, 90, 95, 120, 125, 180]))) for i in range(60)]
    asks = [(100 + r, *pool[draw.randrange(60)]) for r in range(25)]
    seen = [(100 + r, draw.randrange(60)) for r in range(25) for _ in range(6)] * 2
    return pool, asks, seen, (
        spark.createDataFrame(asks, "req long, track long, style string, bpm double"),
        spark.createDataFrame(pool, "track long, style string, bpm double"),
        spark.createDataFrame(seen, "req long, track long"),
    )


def test_candidates_against_all_pairs(spark):
    pool, asks, seen, frames = tables(spark)
    near = lambda x, y: min(abs(x - y), abs(x - 2 * y), abs(x - 0.5 * y)) / x <= 0.06
    want = {(r, a, b) for r, a, s, x in asks if x > 0 for b, z, y in pool if y > 0 and z == s and a != b and near(x, y) and (r, b) not in set(seen)}
    got = [(x.req, x.a, x.b) for x in pairs.candidate_pairs(*frames).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_pairs_meet_no_shuffle(spark):
    frames = tables(spark)[3]
    plan = pairs.candidate_pairs(*frames)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan  # an anti join would shuffle every pair


def test_cut_keeps_the_first_rows(spark):
    draw = random.Random(4)
    rows = [(draw.randrange(5), draw.choice([0.1, 0.5, None, float("nan")]), i) for i in range(400)]
    df = spark.createDataFrame(rows, "req long, score double, b long").repartition(3)
    first = lambda d: sorted(map(str, grouping.first_rows(d, ["req"], [F.col("score").desc(), "b"], 4, "rank").collect()))
    cut = grouping.cut_in_tasks(df, "req", {"score": False, "b": True}, 4)
    assert first(cut) == first(df)
    plain = df.filter("score < 1")
    assert grouping.cut_in_tasks(plain, "req", {"score": False, "b": True}, 4).count() <= 60
