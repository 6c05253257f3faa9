"""Pair scores hold no functions over arrays, which Spark interprets row by row."""

from pyspark.sql import functions as F

from seguelake.functions import scoring
from seguelake.functions.numeric import mean_of

ROWS = [(None, None, None, None), (0.0, None, 0.8, 0.1), (3.0, 0.9, 0.1, 0.9), (7.0, 0.6, 0.75, 0.2), (30.0, 0.1, 0.5, 0.5)]


def test_rules_and_means(spark):
    d = spark.createDataFrame(ROWS, "gap double, h double, v double, b double")
    gates = scoring.rule_columns(F.col("gap"), F.lit("direct"), F.col("h"), F.col("v"), F.col("b"))
    light = d.select(*[gates[n].alias(n) for n in ("hard_block", "review", "penalty")], mean_of(F.col("h"), F.col("v"), F.col("b")).alias("mean"))
    assert "lambda" not in light._jdf.queryExecution().optimizedPlan().toString()
    flags = d.select(gates["flags"].alias("flags")).collect()
    for row, got, f in zip(ROWS, light.collect(), flags):
        assert got["review"] == (len(f["flags"]) > 0)
        assert got["hard_block"] == bool({"tempo_extreme", "harmonic_fail", "vocal_fail", "bass_fail"} & set(f["flags"]))
        known = [x for x in row[1:] if x is not None]
        assert (got["mean"] is None) == (not known) and (not known or abs(got["mean"] - sum(known) / len(known)) < 1e-15)
