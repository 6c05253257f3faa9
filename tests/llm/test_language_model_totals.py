import random

import numpy as np
import pytest

from seguelake.llm import pitman_yor


@pytest.fixture(scope="module")
def docs(spark):
    draw = random.Random(8)
    often = [f"w{i}" for i in range(8)]
    rare = [f"r{i}" for i in range(12)]
    rows = [(i, " ".join(draw.choice(often if draw.random() < 0.6 else rare) for _ in range(60))) for i in range(240)]
    return spark.createDataFrame(rows, "doc_id long, text string").cache()


def test_totals_are_those_of_all_slices(docs):
    """One slice knows all totals by itself, so many slices must come to the same scores but for the draws."""
    teach = lambda i: i % 5 != 1
    one = {r.doc_id: r for r in pitman_yor.score(docs, teach, block_rows=1000).collect()}
    many = {r.doc_id: r for r in pitman_yor.score(docs, teach, block_rows=4).collect()}
    assert one.keys() == many.keys() and all(one[i].base_score == pytest.approx(many[i].base_score) for i in one)
    held = [i for i in one if not teach(i)]
    off = sum(many[i].score - one[i].score for i in held) / sum(one[i].n_tokens for i in held)
    assert abs(off) < 0.004, off


def test_a_slice_is_seated_under_the_totals_it_is_given():
    """The new-table weights follow what all slices hold, whatever lies in the slice itself."""
    draw = np.random.default_rng(3)
    pair = np.unique(draw.integers(0, 50 << pitman_yor.FINE, 4000).astype(np.uint64))
    count = draw.integers(0, 60, len(pair))
    run = lambda totals: pitman_yor.sample(pair, count, 50, totals, 0, 9)["totals"]
    own = run([])
    restaurants = slice(1 << pitman_yor.FINE, 2 << pitman_yor.FINE)
    wide = own.copy()
    wide[restaurants] *= 40  # other slices hold many more tables of these restaurants
    assert run([wide])[restaurants].sum() > 1.5 * run([own])[restaurants].sum()


def test_a_slice_repeats_its_sweeps():
    draw = np.random.default_rng(3)
    pair = np.unique(draw.integers(0, 50 << pitman_yor.FINE, 4000).astype(np.uint64))
    count = draw.integers(0, 60, len(pair))
    run = lambda totals: pitman_yor.sample(pair, count, 50, totals, 1, 9)["totals"]
    first = run([])
    second = run([first])
    third = run([first, second])
    assert (run([first]) == second).all() and (run([first, second]) == third).all()
    assert first[: 1 << pitman_yor.FINE].sum() == count.sum() == third[-1]
