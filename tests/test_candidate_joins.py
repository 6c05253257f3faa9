"""How candidates meet their requests."""

from seguelake.operators import pairs


def test_pool_copies_do_not_pass_the_driver(spark):
    requests = spark.createDataFrame([(1, 1, "x", 100.0)], "req long, track long, style string, bpm double")
    pool = spark.createDataFrame([(i, "x", 100.0 + i % 3) for i in range(1, 20)], "track long, style string, bpm double")
    found = pairs.candidate_pairs(requests, pool, spark.createDataFrame([(1, 2)], "req long, track long"))
    plan = found._jdf.queryExecution().sparkPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "salt" in line]
    assert joins and all("ShuffledHashJoin" in line for line in joins)
    assert found.count() == 17
