"""Findings of the review of round 2: each test fails on the code before its fix."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seguelake.llm import decontaminate, quality_rules, statistics, toxicity


def terms_of(text):
    found = re.findall(r"[a-z]+", text.lower())
    return Counter([*found, *[w[:5] + "*" for w in found if len(w) > 5]])


def test_toxicity_searches_all_terms_of_the_examples(spark):
    draw = random.Random(3)
    vocabulary = ["".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 9))) for _ in range(150)]
    texts = [" ".join(draw.choice(vocabulary) for _ in range(30)) for _ in range(90)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(60)], "doc_id long, toxic int")
    got = {r.doc_id: r.evidence for r in toxicity.score(docs, labels, lambda c: F.lit(True)).collect()}
    counts = [terms_of(t) for t in texts]
    spread = Counter(t for c in counts for t in c)
    known = {t for c in counts[:60] for t in c}

    def vector(c):
        v = {t: (1 + math.log(n)) * math.log(1 + len(texts) / spread[t]) for t, n in c.items() if t in known}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / size for t, x in v.items()}

    vectors = [vector(c) for c in counts]
    for i, v in enumerate(vectors):
        cosines = [(-round(sum(x * w.get(t, 0) for t, x in v.items()), 9), j) for j, w in enumerate(vectors[:60]) if j != i]
        assert got[i] == [j for _, j in sorted(cosines)[:3]]


def test_rare_and_common_terms_give_exact_cosines():
    draw = np.random.default_rng(6)
    terms, vectors = 5000, []
    for _ in range(300):
        t = np.unique(np.minimum((draw.pareto(0.6, 200) * 20).astype(np.int64), terms - 1))
        w = draw.random(len(t)) + 0.1
        vectors.append((t, w / np.sqrt(w @ w)))
    vectors[7] = vectors[3]
    index = toxicity.ExampleIndex(list(range(300)), np.zeros(300, np.int64), vectors, np.ones(300), 0.1, terms)
    whole = np.zeros((300, terms))
    for i, (t, w) in enumerate(vectors):
        whole[i, t] = w
    for i, (t, w) in enumerate(vectors[:40]):
        found, cosines = index.nearest(t, w, 15, skip=i)
        dense = whole @ whole[i]
        dense[i] = -1
        assert np.allclose(cosines, np.sort(dense)[::-1][:15]) and cosines == pytest.approx(dense[found])


ITEM = "a train leaves Rome at 9 and covers 40 km before it meets another train from Oslo in Rome"
TABLE = "Rome 12 Oslo 40 Lima 7 Bonn 33 Paris 5 Kyoto 81 Quito 64 Accra 90"


def found(spark, items, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {(r.doc_id, r.item_id): r for r in decontaminate.leaks(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}


def test_exact_copies_in_any_case_and_without_plain_words(spark):
    got = found(spark, [ITEM, TABLE], [f"so {ITEM.upper()} ok", f"SO {ITEM.lower()} OK", f"x {TABLE} y", f"x {TABLE.lower()} y", "Rome 12 Oslo 41 Lima 7 Bonn 33 Paris 6 Kyoto 81 Quito 64 Accra 91"])
    assert set(got) == {(0, 0), (1, 0), (2, 1), (3, 1)}
    assert {(r.covered_words, r.item_words, r.n_changed) for r in got.values()} == {(19, 19, 0), (16, 16, 0)}


def test_a_contradicted_value_removes_only_its_windows(spark):
    item = "the clerk Anna sold nine red pens to the school and later the clerk counted every pen again before Anna went home to rest"
    other = item.replace("before Anna", "before Berta")
    apart = item.replace("clerk Anna", "clerk Carla").replace("before Anna", "before Berta")
    swapped = item.replace("Anna", "Berta")
    got = found(spark, [item], [other, apart, swapped])
    assert {k: (r.covered_words, r.n_changed) for k, r in got.items()} == {(0, 0): (19, 0), (1, 0): (16, 0), (2, 0): (24, 1)}


def test_quality_rules_reject_junk_in_small_strata(spark):
    draw = random.Random(5)
    plain = lambda: " ".join("".join(draw.choice("abcdefgh") for _ in range(5)) + ("," if draw.random() < 0.1 else "") for _ in range(60))
    junk = lambda: " ".join("#" * 4 + draw.choice("abcdefgh") * 2 + str(draw.randint(0, 99)) for _ in range(60))
    given = [(lang, good) for lang, n in (("en", 900), ("es", 330), ("eu", 180), ("mt", 190)) for good in [1] * n + [0] * 20]
    docs = spark.createDataFrame([(i, plain() if good else junk(), lang) for i, (lang, good) in enumerate(given)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, good) for i, (_, good) in enumerate(given)], "doc_id long, quality int")
    lost = Counter()
    for r in quality_rules.assess(docs, labels).collect():
        lang, good = given[r.doc_id]
        assert not r.base_failed
        lost[lang, good] += not r.kept
    for lang, n in (("en", 900), ("es", 330), ("eu", 180), ("mt", 190)):
        assert lost[lang, 0] == 20 and lost[lang, 1] <= 0.02 * n, (lang, lost)
    few = labels.filter("doc_id < 950 or doc_id > 1500")
    limits = quality_rules.thresholds(statistics.document_counts(docs, keep=("doc_id", "lang")), few, "lang")
    assert {(r.stratum, r.pooled) for r in quality_rules.uncovered(limits).collect()} == {("es", True), ("mt", True)}


def test_unlike_texts_of_one_id_stay(spark):
    from seguelake.llm import jaccard_join

    one, other = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, one, "x"), (1, other, "y"), (2, one, "z"), (1, one, "w"), (3, other + " end", "v")]
    kept = [tuple(r) for r in jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).collect()]
    assert sorted(r[:2] for r in kept) == [(1, one), (1, other)]
    again = [tuple(r) for r in jaccard_join.keep_one(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string").repartition(2)).collect()]
    assert sorted(kept) == sorted(again)
