"""The discovery walk, decided in rounds, against the walk item by item."""

import random

import numpy as np
import pytest

from seguelake.operators import discovery


def walked(items, near_copy, hub_cap):
    kept = []
    for id_, rank, tkey, hubs, v in sorted(items, key=lambda r: r[1]):
        if any(t == tkey or float(np.dot(v, w)) > near_copy for _, _, t, _, w in kept):
            continue
        hub = next((h for h in hubs if sum(k == h for _, _, _, k, _ in kept) < hub_cap), None)
        if hub is not None:
            kept.append((id_, rank, tkey, hub, v))
    return sorted((i, r, h) for i, r, _, h, _ in kept)


def items(seed, n, dims=5):
    draw = random.Random(seed)
    numpy = np.random.default_rng(seed)
    bases = [numpy.normal(size=dims) for _ in range(n // 4)]
    out = []
    for i in range(n):
        # a third of all rows are near copies of one base, and one hub is named by most
        base = bases[0] if i % 3 == 0 else draw.choice(bases)
        v = base + numpy.normal(size=dims) * draw.choice([0, 0.02, 0.3])
        hubs = draw.sample(range(1, 12), 2)
        hubs = [0, *hubs] if draw.random() < 0.6 else [*hubs, 0]
        out.append((i, 0, f"t{draw.randint(0, n // 2)}", hubs, (v / np.linalg.norm(v)).tolist()))
    ranks = list(range(n))
    draw.shuffle(ranks)
    return [(i, r, t, h, v) for (i, _, t, h, v), r in zip(out, ranks)]


@pytest.mark.parametrize(("seed", "near_copy", "hub_cap"), [(1, 0.995, 2), (2, 0.9, 1)])
def test_rounds_give_the_walk(spark, monkeypatch, seed, near_copy, hub_cap):
    monkeypatch.setattr(discovery, "BLOCK_ROWS", 13)
    rows = items(seed, 80)
    schema = "id long, rank long, tkey string, hubs array<long>, v array<double>"
    got = [sorted(map(tuple, discovery.walk(spark.createDataFrame(some, schema).repartition(3), near_copy, hub_cap).collect())) for some in ((rows, rows[::-1]) if seed == 1 else (rows,))]
    assert all(g == walked(rows, near_copy, hub_cap) for g in got) and len(got[0]) > 8


def test_no_items(spark):
    empty = spark.createDataFrame([], "id long, rank long, tkey string, hubs array<long>, v array<double>")
    assert discovery.walk(empty).collect() == []


def test_numbered_splits_ties(spark):
    from pyspark.sql import functions as F

    from seguelake import grouping

    rows = spark.range(0, 1000, 1, 7).select(F.lit(1).alias("same"), "id")
    got = grouping.numbered(rows, [F.col("same"), F.col("id").desc()]).collect()
    assert {r.id: r.position for r in got} == {i: 1000 - i for i in range(1000)}
