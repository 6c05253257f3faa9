"""The search behind the novelty queries is made once, however often its cases are read."""

from seguelake import queries as registry
from seguelake.bindings import Tables
from seguelake.queries import vectors


def test_search_is_cut_off(spark):
    registry.load_all()
    cases = vectors.novel_cases(Tables(spark, "/root/testdata/sf0.001"))
    plan = cases._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" not in plan and "Join" not in plan
    assert cases.count() == cases.select("id").distinct().count() > 0
