"""Queries and statements agree on where a word ends in texts of any script."""

import duckdb
import pytest

from seguelake import queries as registry

TEXTS = ["le desé", "Les élèves", "lesé des", "ſ leſ", "x_the the_", "THE", "the2", "élesà und", "uné undé", "a\nund", None, "copyright the"]


@pytest.mark.parametrize("name", ["event_membership", "multi_label_markers"])
def test_words_end_alike(spark, tmp_path, name):
    registry.load_all()
    rows = [(i, x) for i, x in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in registry.QUERIES[name](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == sorted(con.sql(registry.SQL[name]).fetchall())
    if name == "event_membership":
        assert dict(got) == {2: "beta", 5: "alpha", 7: "gamma", 9: "gamma"}
    else:
        assert dict(got) == {"the": 2, "les": 2, "number": 1}
