"""Groups that are counted inside one row, against the ways that take groups of any size; inputs that are to be read once."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from seguelake.functions import vectors
from seguelake.operators import aggregates, evaluation, series

c = F.col


def counted(spark, df, column):
    """The table with a column that counts how often its rows are derived."""
    seen = spark.sparkContext.accumulator(0)

    def look(x):
        seen.add(1)
        return x

    return df.withColumn(column, F.udf(look, "double")(column)), seen


def rows(df):
    return sorted(df.collect(), key=str)


@pytest.fixture()
def orders(spark):
    draw = np.random.default_rng(4)
    out = []
    for mix, n in enumerate([1, 2, 3, 4, 9, 12]):
        places = np.sort(draw.choice(40, n, replace=False)) + 1  # a real order may have gaps
        for p, i in enumerate(draw.permutation(n)):
            out.append((mix, int(i) * 7 + mix, p + 1, int(places[i])))
    return spark.createDataFrame(out, "mix long, track long, p long, q long")


def test_runs_walked_and_jumped_agree(spark):
    draw = np.random.default_rng(1)
    data = [(g, i + 1, int(draw.integers(6)), None if draw.random() < 0.1 else int(draw.integers(5)), bool(draw.random() < 0.9)) for g in range(12) for i in range(int(draw.integers(1, 30)))]
    d = spark.createDataFrame(data, "mix long, position long, item long, audio long, qualified boolean").filter("qualified")
    bins = [F.floor(c("position") / 4)]
    short = series._walked_runs(d, "mix", "position", ["item", "audio"], 2)
    assert rows(short) == rows(series._jumped_runs(d, "mix", "position", bins, ["item", "audio"], 2).select(short.columns))
    assert short.count()


def test_orders_short_and_long_agree(spark, orders):
    bins = [F.floor(c("position") / 4)]
    short = (evaluation.reconstruction_of_orders(orders, "mix", "track", bins), evaluation.agreement_of_orders(orders, "mix", "track", bins, 6, 5))
    left, right = orders.select("mix", "track", c("p").alias("position")), orders.select("mix", "track", c("q").alias("position"))
    long = (evaluation.sequence_reconstruction(left, right, "mix", "position", "track", bins), evaluation.order_agreement(left, right, "mix", "position", "track", bins, 6, 5))
    for a, b in zip(short, long):
        for x, y in zip(a.orderBy("mix").collect(), b.select(a.columns).orderBy("mix").collect(), strict=True):
            assert x.asDict() == pytest.approx(y.asDict(), abs=1e-9)


def test_orders_above_the_limit(small_groups, orders):
    bins = [F.floor(c("position") / 4)]
    mixed = evaluation.reconstruction_of_orders(orders, "mix", "track", bins).orderBy("mix").collect()
    small_groups.conf.unset("seguelake.hotGroupRows")
    for x, y in zip(mixed, evaluation.reconstruction_of_orders(orders, "mix", "track", bins).orderBy("mix").collect(), strict=True):
        assert x.asDict() == pytest.approx(y.asDict(), abs=1e-9)


def test_signature_reads_its_pairs_once(spark):
    d = spark.range(40).select((c("id") % 5).alias("dj"), (c("id") / 7).alias("distance"), (c("id") % 3).cast("double").alias("jump"), F.lit("exact").alias("relation"))
    d, seen = counted(spark, d, "distance")
    assert len(aggregates.transition_signature(d, "dj", 2).collect()) == 5
    assert seen.value == 40


def test_ladder_reads_its_cases_twice_at_most(spark):
    draw = np.random.default_rng(3)
    data = [(case, at, float(draw.integers(4)), float(draw.integers(4))) for case in range(9) for at in range(1, 2 + case)]
    d, seen = counted(spark, spark.createDataFrame(data, "mix long, position long, x double, y double"), "x")
    got = evaluation.ablation_ladder(d, ["mix"], c("position") == 1, [("x", {"x": 1.0}), ("both", {"x": 1.0, "y": 0.5})]).orderBy("step").collect()
    assert seen.value <= 2 * len(data)
    for rung, score in zip(got, (lambda r: r[2], lambda r: r[2] + 0.5 * r[3])):
        ranks = []
        for case in range(1, 9):
            scores = [score(r) for r in data if r[0] == case]
            ranks.append((1 + sum(s > scores[0] for s in scores) + (sum(s == scores[0] for s in scores) - 1) / 2, len(scores)))
        assert rung["cases"] == 8
        assert rung["top1"] == pytest.approx(np.mean([r <= 1 for r, _ in ranks]))
        assert rung["median_pct"] == pytest.approx(np.median([(r - 1) / (n - 1) for r, n in ranks]))


def test_contour_moves_ids(spark):
    draw = np.random.default_rng(5)
    vecs = {i: draw.normal(size=4).tolist() for i in range(4)}
    plays = [(1, 1, 1, 0), (1, 1, 2, 9), (1, 1, 3, 2), (1, 1, 4, 3), (1, 2, 1, 1), (2, 5, 1, 1), (2, 5, 2, 1)]  # 9 has no vector
    table = spark.createDataFrame(list(vecs.items()), "id long, vec array<double>")
    out = series.jump_contour(spark.createDataFrame(plays, "dj long, mix long, position long, id long"), table, "dj", "mix", "position", [F.lit(0)])
    cos = lambda a, b: np.dot(vecs[a], vecs[b]) / np.linalg.norm(vecs[a]) / np.linalg.norm(vecs[b])
    got = {(r["dj"], r["mix"], r["position"]): r["cos"] for r in out.collect()}
    assert got == pytest.approx({(1, 1, 1): cos(0, 2), (1, 1, 3): cos(2, 3), (2, 5, 1): 1.0})


def test_only_light_vectors_are_broadcast(spark, monkeypatch):
    table = spark.createDataFrame([(1, [0.0, 1.0]), (2, None)], "id long, vec array<double>")
    plan = lambda: vectors.light(table)._jdf.queryExecution().logical().toString()
    assert "broadcast" in plan()
    monkeypatch.setattr(vectors, "BROADCAST_BYTES", 8)
    assert "broadcast" not in plan()
