"""Rows cut by bounds are never among the first of their group."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from seguelake import grouping


def rows(seed=3, n=4000):
    r = np.random.default_rng(seed)
    low = np.round(r.random(n), 2)  # ties
    frame = {"g": r.integers(0, 8, n), "b": np.arange(n), "tier": r.integers(0, 2, n), "low": low, "high": low + 0.14, "sure": r.random(n) < 0.95, "k": 7}
    d = pd.DataFrame(frame)
    d.loc[d["g"] == 5, "tier"] = 1  # a group without a row of the first tier
    d.loc[(d["g"] == 6) & (d["b"] > 40), "g"] = 7  # a group that is smaller than k
    return d


def test_first_rows_stay(spark):
    d = rows()
    kept = grouping.cut_by_bounds(spark.createDataFrame(d).repartition(4, "g"), "g", "tier", "low", "high", "sure", "k", 1e-8).select("b").toPandas()["b"]
    assert len(kept) < len(d) / 2 and set(d.loc[~d["sure"], "b"]) <= set(kept)
    for seed in range(5):  # any values between the bounds, and any two rows of a group left out
        r = np.random.default_rng(seed)
        v = d.assign(value=d["low"] + 0.14 * r.integers(0, 2, len(d)))
        v = v.drop(index=v.groupby("g").sample(2, random_state=seed).index)
        first = v.sort_values(["g", "tier", "value", "b"], ascending=[True, True, False, True]).groupby("g").head(5)
        assert set(first["b"]) <= set(kept)


def test_pairs_are_scored_once(spark):
    from seguelake import queries as registry
    from seguelake.bindings import Tables
    from seguelake.queries import ranking

    registry.load_all()
    t = Tables(spark, "/root/testdata/sf0.001")
    asks = ranking.requests_of(t)
    pairs = ranking.candidates_of(t, asks)
    assert pairs.count() == pairs.select("a", "b").distinct().count()
    assert asks.agg(F.count_distinct("a")).collect()[0][0] < asks.count()
