"""Shared histories against lists per target."""

from datetime import date, timedelta

from pyspark.sql import functions as F

from seguelake.operators import histories


def test_members_of_prior_sets(spark, monkeypatch):
    monkeypatch.setattr(histories, "WIDTH", 256)
    # one DJ holds most sets; days repeat, so equal days never count as earlier
    rows = [(m, 1 if m % 4 else 2, date(2024, 1, 1) + timedelta(days=m * 7 % 50)) for m in range(120)]
    mixes = spark.createDataFrame(rows, "mix long, dj long, day date").repartition(4)
    plays = mixes.select("mix", F.lit(1).cast("long").alias("track"))
    for window in (None, 10):
        references, chunks = histories.prior_sets(mixes, plays, window)
        got = {(r.mix, r.member.prior_mix) for r in histories.members(references, chunks, ["dj"]).collect()}
        want = {(m, p) for m, dj, day in rows for p, other, before in rows if dj == other and before < day and (window is None or (day - before).days <= window)}
        assert got == want and references.count() == 120 and chunks.agg(F.sum(F.size("members"))).first()[0] == 120


def test_chunks_of_a_null_group_and_odd_widths(spark):
    items = spark.createDataFrame([(None if i % 3 else 1, i) for i in range(50)], "g long, i long").repartition(3)
    chunks = histories.chunked(items, ["g"], [F.col("i")], ["i"], width=4)
    assert chunks.agg(F.max(F.size("members"))).first()[0] == 4
    references = spark.createDataFrame([(1, 3, 11), (None, 0, 2), (None, 30, 33), (1, 5, 5)], "g long, first long, last long")
    got = sorted((str(r.g), r.member.i) for r in histories.members(references, chunks, ["g"], width=4).collect())
    ones, nones = [i for i in range(50) if i % 3 == 0], [i for i in range(50) if i % 3]
    assert got == sorted([("1", i) for i in ones[3:11]] + [("None", i) for i in nones[:2] + nones[30:33]])
