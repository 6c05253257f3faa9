"""The exact assignment test against enumeration; the window table function against the joins it replaces."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from seguelake.operators import table_functions
from seguelake.operators.evaluation import exact_assignment
from seguelake.operators.series import spaced_peaks


def enumerated(values, control):
    k, total = sum(control), sum(values)
    delta = lambda chosen: (total - sum(values[i] for i in chosen)) / (len(values) - k) - sum(values[i] for i in chosen) / k
    seen = delta([i for i, x in enumerate(control) if x])
    every = [delta(x) for x in itertools.combinations(range(len(values)), k)]
    return seen, sum(d >= seen - 1e-9 for d in every) / len(every)


def test_p_is_that_of_all_assignments(spark):
    draw = random.Random(2)
    rows, want = [], {}
    for test in range(12):
        n = draw.randint(3, 10)
        values = [draw.choice([-0.5, 0.0, 1.25, 2.0, draw.randint(0, 500) / 100]) for _ in range(n)]
        control = [draw.random() < 0.4 for _ in range(n)]
        control[0], control[1] = True, False
        want[test] = enumerated(values, control)
        rows += [(test, v, x) for v, x in zip(values, control)]
    rows += [(90, 1.0, True), (91, None, True), (91, 2.0, False), (92, 3.0, None)]
    got = {r.test: r for r in exact_assignment(spark.createDataFrame(rows, "test long, v double, control boolean").repartition(3), "test", "v", "control").collect()}
    for test, (delta, p) in want.items():
        assert got[test].delta == pytest.approx(delta) and got[test].p == pytest.approx(p), test
    assert got[90].p is None and got[91].p is None and 92 not in got


def test_many_equal_values(spark):
    rows = spark.range(4000).select(F.lit(1).alias("test"), (F.col("id") % 5).cast("double").alias("v"), (F.col("id") % 2 == 0).alias("control"))
    found = exact_assignment(rows, "test", "v", "control").first()
    assert found.delta == 0 and 0.5 < found.p < 0.52


def test_window_function(spark):
    draw = random.Random(4)
    rows = [(g, float(draw.randint(0, 200)), draw.randint(0, 30) / 10) for g in (1, 2, 3) for _ in range(60)] + [(4, 5.0, 1.0)]
    span = spark.createDataFrame([(g, t, s) for g, t, s in {(g, t): (g, t, s) for g, t, s in rows}.values()], "g long, t double, s double")
    want = spaced_peaks(span, span, "g", "t", "s", 4, 20.0, 6.0).select("g", "rank", "peak", "s", "start", "end").collect()
    got = table_functions.windows_by_function(span, span, "g", "t", "s", 4, 20.0, 6.0).select("g", "rank", "peak", "score", "start", "end").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    table_functions.register(spark)
    span.selectExpr("g", "t AS peak", "s AS score", "0D AS first", "200D AS last").createOrReplaceTempView("candidate_peaks")
    by_sql = spark.sql("SELECT * FROM pick_windows(TABLE(candidate_peaks) PARTITION BY g ORDER BY (score DESC, peak), 1, 20D, 6D)").collect()
    assert sorted((r.peak, r.score) for r in by_sql) == sorted((r.peak, r.s) for r in want if r.rank == 1)


def test_long_tests_against_convolution(spark):
    """Values 0 and 1 only: the control sum is hypergeometric, whatever the number of rows."""
    rows = spark.range(400_000).select(F.lit(1).alias("test"), (F.col("id") % 3 == 0).cast("double").alias("v"), (F.col("id") * 7919 % 400_009 < 60_000).alias("control"))
    m, ones, k, seen = rows.select(F.count(F.lit(1)), F.sum("v").cast("long"), F.count_if("control"), F.sum(F.when(F.col("control"), F.col("v"))).cast("long")).first()
    log_choose = lambda n, i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1)
    weigh = lambda i: math.exp(log_choose(ones, i) + log_choose(m - ones, k - i) - log_choose(m, k))
    want = sum(weigh(i) for i in range(max(0, seen - 5000), seen + 1))
    found = exact_assignment(rows, "test", "v", "control").first()
    assert 0.001 < want < 0.999 and found.p == pytest.approx(want, abs=1e-6)


def test_first_and_last_assignment(spark):
    values = [float(i % 7) for i in range(60)]
    ordered = sorted(range(60), key=lambda i: values[i])
    for chosen, p in ((ordered[:9], 1 / math.comb(9, 9)), (ordered[-9:], None)):
        rows = [(1, x, i in chosen) for i, x in enumerate(values)]
        found = exact_assignment(spark.createDataFrame(rows, "test long, v double, control boolean"), "test", "v", "control").first()
        assert found.p == pytest.approx(1.0) if p is None else found.p == pytest.approx(1 / math.comb(60, 9), abs=1e-9)
