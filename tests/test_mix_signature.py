"""Mix signatures from vector ids: repeated vectors, rows without a vector."""

import numpy as np

from pyspark.sql import functions as F

from seguelake.operators import aggregates


def test_signature_from_ids(spark):
    draw = np.random.default_rng(2)
    vecs = {i: draw.normal(size=4).tolist() for i in range(5)}
    ids = [0, 1, 1, 4, 2, 9, 0, 3, 3, 2]  # 9 has no vector
    rows = [(7, at, 120.0 + at, i) for at, i in enumerate(ids)]
    out = aggregates.mix_signature(
        spark.createDataFrame(rows, "dj long, o long, bpm double, id long"), spark.createDataFrame(list(vecs.items()), "id long, vec array<double>"), "dj", "o", [F.lit(0)]
    ).collect()
    unit = [np.array(vecs[i]) / np.linalg.norm(vecs[i]) for i in ids if i in vecs]
    n, total = len(unit), np.sum(unit, axis=0)
    assert out[0].n == n
    assert np.isclose(out[0].palette, (total @ total - n) / (n * (n - 1)))
    assert np.isclose(out[0].cos_median, np.median([a @ b for a, b in zip(unit, unit[1:])]))
