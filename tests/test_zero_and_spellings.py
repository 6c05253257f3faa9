"""Empty splits, a first tempo of zero, and names in several spellings."""

from pyspark.sql import functions as F

from seguelake.operators.evaluation import split_audit
from seguelake.operators.series import sequence_guardrails
from seguelake.operators.vectors import snowball


def test_an_empty_split_gives_nulls(spark):
    rows = spark.createDataFrame([("train", "x", 1), ("train", "y", 2), ("test", "x", 1)], "split string, target string, item long")
    got = {(r.left, r.right): (r.tv, r.shared, r.shared_share) for r in split_audit(rows, "split", "target", "item", ["train", "valid", "test"]).collect()}
    assert got[("train", "test")] == (0.5, 1, 1.0) and got[("train", "valid")] == (None, 0, None)


def test_a_first_tempo_of_zero(spark):
    steps = spark.createDataFrame([(1, 1, 0.1, 0.0, "low"), (1, 2, 0.2, 120.0, "low")], "mix long, position long, risk double, bpm double, region string")
    got = sequence_guardrails(steps, "mix", "position", [F.lit(0)], F.lit("build")).collect()
    assert len(got) == 1 and got[0].span is None


def test_breadth_counts_names_not_spellings(spark):
    edges = [("A", "b", 5), ("a", "B", 9), ("a", "c", 7), ("A", "d", 6), ("B", "e", 1)]
    got = {(r.key, r.level) for r in snowball(spark.createDataFrame(edges, "src string, dst string, match long"), spark.createDataFrame([("A",)], "name string"), 2, 2, 50).collect()}
    assert got == {("a", 0), ("b", 1), ("c", 1), ("e", 2)}
