"""The spread paths for large groups must give the rows of a plain window."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seguelake import grouping

c = F.col


@pytest.fixture(scope="module")
def data():
    rng = random.Random(5)
    rows = [("hot", i, round(rng.random() * 100, 3), None if rng.random() < 0.3 else rng.randint(1, 9)) for i in range(57)]
    rows += [("a", i, float(i), i) for i in range(3)] + [("b", 7, 1.5, None)] + [(None, i, 2.0 * i, i) for i in range(11)]
    return rows


def frame(spark, data):
    return spark.createDataFrame(data, "k string, t long, v double, n int")


def bins():
    return [F.floor(c("t") / 7)]


def by_key(data):
    out = {}
    for k, t, v, n in data:
        out.setdefault(k, []).append((t, v, n))
    return {k: sorted(r) for k, r in out.items()}


def test_position(small_groups, data):
    got = grouping.position(frame(small_groups, data), ["k"], ["t"], bins()).collect()
    want = {(k, r[0]): i + 1 for k, rows in by_key(data).items() for i, r in enumerate(rows)}
    assert {(r["k"], r["t"]): r["position"] for r in got} == want


def test_global_position(small_groups, data):
    got = grouping.position(frame(small_groups, data).filter("k = 'hot'"), [], ["v", "t"], [F.floor(c("v") / 10)]).collect()
    order = sorted((r["v"], r["t"]) for r in got)
    assert [order.index((r["v"], r["t"])) + 1 for r in got] == [r["position"] for r in got]


@pytest.mark.parametrize("radius", [1, 3])
def test_windowed(small_groups, data, radius):
    def step(d, w):
        return d.withColumn("before", F.lag("v", radius).over(w())).withColumn("after", F.lead("v", radius).over(w()))

    got = grouping.windowed(frame(small_groups, data), ["k"], ["t"], bins(), radius, step, cell_rows=4).collect()
    groups = by_key(data)
    assert len(got) == len(data)
    for r in got:
        rows = groups[r["k"]]
        i = [x[0] for x in rows].index(r["t"])
        assert r["before"] == (rows[i - radius][1] if i >= radius else None)
        assert r["after"] == (rows[i + radius][1] if i + radius < len(rows) else None)


@pytest.mark.parametrize("reverse", [False, True])
def test_running(small_groups, data, reverse):
    d = grouping.running(
        frame(small_groups, data), ["k"], ["t"], bins(), sums={"s": c("n")}, lasts={"l": c("n")}, maxima={"m": c("v")}, reverse=reverse
    )
    groups = by_key(data)
    for r in d.collect():
        rows = groups[r["k"]][::-1] if reverse else groups[r["k"]]
        upto = rows[: [x[0] for x in rows].index(r["t"]) + 1]
        known = [x[2] for x in upto if x[2] is not None]
        assert r["s"] == (sum(known) if known else None)
        assert r["l"] == (known[-1] if known else None)
        assert r["m"] == max(x[1] for x in upto)


def test_quantiles(small_groups, data):
    d = grouping.quantiles(frame(small_groups, data), ["k"], "v", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    groups = by_key(data)
    for r in d.collect():
        want = np.quantile([x[1] for x in groups[r["k"]]], [0.1, 0.5, 0.9])
        assert [r["p10"], r["p50"], r["p90"]] == pytest.approx(list(want))
    whole = grouping.quantiles(frame(small_groups, data), [], "v", {"p": 0.35}).first()["p"]
    assert whole == pytest.approx(np.quantile([x[2] for x in data], 0.35))


def test_top_rows_are_cut_before_the_shuffle(spark, data):
    d = grouping.first_rows(frame(spark, data), ["k"], [c("v").desc()], 2)
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
