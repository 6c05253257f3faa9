"""Long scoring expressions."""

from seguelake import queries as registry

SMALL = "/root/testdata/sf0.001"


def test_long_scores_are_split(spark):
    registry.load_all()
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    registry.QUERIES["suggest_slot"](spark, SMALL)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "20000")  # a session's own value
    registry.QUERIES["suggest_slot"](spark, SMALL)
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "20000"
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
