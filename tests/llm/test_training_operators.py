"""Each operator against brute force on a small fixture with nulls, empty and long texts, repeats and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seguelake.llm import decontaminate, jaccard_join, license_scan, lz_dedup, mixture, pitman_yor, quality_model, quality_rules, records, statistics, toxicity
from seguelake.llm import words as W
from seguelake.llm.queries import tokenizer_file
from seguelake.session import scratch_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, n_words string, block string"
UP = {i: i + 32 for i in range(65, 91)}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def texts():
    draw = random.Random(4)
    vocabulary = ["an", "thor", "ing", "blé", "ñas", "of", "the", "Ede", "re.", "wh,", "tion", "ou", "3", "km"] + [f"w{i}" for i in range(300)]
    sentence = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    base = sentence(120)
    near = [" ".join(w if i != j * 3 else f"x{j}" for i, w in enumerate(base.split())) for j in range(12)]
    passage = sentence(60)
    rows = [base, base, *near, passage + "\n" + sentence(40), sentence(30) + " " + passage, "", None, "   \n", "One", "One two", "a b c", "be " * 80, sentence(9000)]
    return rows + [sentence(draw.randint(1, 90)) for _ in range(40)]


@pytest.fixture(scope="module")
def rows():
    out = [(i, t, ["en", "fr", None][i % 3], "s0" if i % 3 else "s1", None, "clash", "b") for i, t in enumerate(texts())]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    # a null id and a repeated row come on top
    return spark.createDataFrame([*rows, (None, rows[0][1], None, None, None, None, None), rows[3]], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows):
    return spark.createDataFrame([(r[0], r[0] % 2, int("x1" in (r[1] or ""))) for r in rows] + [(None, 1, 1), (10**6, 0, 0), (3, 7, 7)], "doc_id long, quality int, toxic int")


def test_counts(docs, rows):
    got = {r.doc_id: r for r in statistics.document_counts(docs).collect() if r.doc_id is not None}
    for doc_id, text, *_ in rows:
        w = words(text)
        seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        again = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in (text or "").split("\n") if words(x)]
        r = got[doc_id]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(again))


def test_quality_rules(spark, docs, rows, nothing):
    judged = {r.doc_id: r for r in quality_rules.assess(docs, labels(spark, rows)).collect()}
    for doc_id, text, *_ in rows:
        if len(words(text)) < 50:
            assert judged[doc_id].base_failed and not judged[doc_id].kept
    assert judged[0].kept and len(judged) == len(rows) + 1
    assert quality_rules.keep_good(docs, labels(spark, rows)).columns == docs.columns
    assert quality_rules.assess(nothing, labels(spark, rows)).count() == 0


def test_binomial_walk():
    exact = sum(math.comb(50, i) * 0.1**i * 0.9 ** (50 - i) for i in range(4))
    assert quality_rules.binomial_tail(3, 50, 0.1) == pytest.approx(exact)
    assert quality_rules.strictest([0, 0, 1, 40], 1000, 0.01, 0.01) == 2
    assert quality_rules.strictest([0], 10, 0.01, 0.01) is None


def test_quality_model(spark, docs, rows, nothing):
    teach = lambda c: F.lit(True)
    scored = quality_model.score(docs, labels(spark, rows), teach, features=32).collect()
    assert len(scored) == len(rows) + 2 and all(0 <= r.score <= 1 for r in scored)
    assert {r.score for r in quality_model.score(docs, labels(spark, rows).limit(0), teach, features=32).collect()} == {0.5}
    assert quality_model.score(nothing, labels(spark, rows), teach, features=32).count() == 0
    knots, values = quality_model.isotonic(np.array([0.0, 1.0, 2.0]), np.array([1.0, 0.0, 2.0]), np.array([1.0, 1.0, 2.0]))
    assert list(values) == [0.5, 1.0] and list(knots) == [0.5, 2.0]


def test_toxicity(spark, docs, rows, nothing):
    scored = toxicity.score(docs, labels(spark, rows), lambda c: F.lit(True), chi2=1.0, min_docs=1).collect()
    assert len(scored) == len(rows) + 2 and all(0 <= r.score <= 1 for r in scored)
    assert {r.score for r in toxicity.score(docs, labels(spark, rows).limit(0), lambda c: F.lit(True)).collect()} == {0.0}
    assert toxicity.score(nothing, labels(spark, rows), lambda c: F.lit(True)).count() == 0


def test_block_max_search_is_exact():
    draw = np.random.default_rng(2)
    vectors = []
    for _ in range(500):
        t = np.unique(draw.integers(0, 60, 6))
        w = draw.random(len(t)) + 0.1
        vectors.append((t, w / np.sqrt(w @ w)))
    index = toxicity.ExampleIndex(list(range(500)), np.zeros(500, np.int64), vectors, np.ones(500), 0.1, 60)
    for t, w in vectors[:40]:
        dense = np.zeros(60)
        dense[t] = w
        best = sorted((dense[vectors[i][0]] @ vectors[i][1] for i in range(500)), reverse=True)[:15]
        assert np.allclose(index.nearest(t, w, 15)[1], best)


def brute_components(rows, n, percent):
    sets = {}
    for doc_id, text, *_ in rows:
        w = words((text or "").translate(UP))
        sets[doc_id] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    label = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    label[a] = min(label[a], label[b])
    return {d: (len(s), label[d]) for d, s in sets.items()}


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_jaccard_join(docs, rows, n, percent):
    got = jaccard_join.link_documents(docs, n, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == brute_components(rows, n, percent)
    assert len(got) == len(rows) + 2


def test_keep_one(docs, rows, nothing):
    kept = jaccard_join.keep_one(docs)
    want = {d for d, (_, label) in brute_components(rows, 5, 80).items() if d == label}
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(want) and kept.columns == docs.columns
    assert jaccard_join.keep_one(nothing).count() == 0


def test_sketches_never_exceed_the_difference():
    draw = np.random.default_rng(1)
    for _ in range(50):
        a = np.unique(draw.integers(0, 400, 200)).astype(np.uint64)
        b = np.unique(draw.integers(0, 400, 200)).astype(np.uint64)
        apart = sum(bin(int(x) & (2**64 - 1)).count("1") for x in jaccard_join.parity_sketch(a) ^ jaccard_join.parity_sketch(b))
        gap = len(np.setxor1d(a, b))
        assert apart <= gap and jaccard_join.suffix_apart(a, b, 10**6) <= gap


def test_records(spark, docs, rows, nothing):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file())
    folder = scratch_path(spark, "t")
    records.write_records(docs, tokenizer_file(), folder)
    index = records.with_starts(spark.read.parquet(f"{folder}/index")).orderBy("start").collect()
    start = 0
    by_id = {r[0]: r[1] for r in rows}
    assert index[0].doc_id is None and [r.doc_id for r in index[1:]] == sorted([*by_id, 3])
    for r in index:
        ids = np.array([*tokenizer.encode(by_id[r.doc_id or 0] or "", add_special_tokens=False).ids, 1], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert records.read_shuffled(spark, folder, 1).count() == len(rows) + 2
    empty = scratch_path(spark, "t")
    records.write_records(nothing, tokenizer_file(), empty)
    assert spark.read.parquet(f"{empty}/index").count() == 0


def test_piece_encoder_and_broken_records():
    from tokenizers import Tokenizer

    odd = ["It's DON'T x'll", "<|endoftext|> a<|EndOfText|>", "áb é. ñ,ñ Σας", "1st 3.5km -- (a)[b] don't,'s", "日本語。abc", "​a b", "İx."]
    coder, tokenizer = records.PieceEncoder(tokenizer_file()), Tokenizer.from_file(tokenizer_file())
    for text in odd:
        ids, _ = coder.block(next(W.blocks(pa.array([text]))))
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text
    good = records.frame(records.pack(5, np.array([1, 2]), 2)) + b"\n"
    assert [records.unpack(p)[1].tolist() for _, _, p in records.frames(memoryview(good))] == [[1, 2]]
    with pytest.raises(ValueError):
        list(records.frames(memoryview(good[:14] + b"\x07" + good[15:])))


def test_language_model(docs, rows, nothing):
    teach = lambda i: i is None or i % 5 != 1
    got = pitman_yor.score(docs, teach, block_rows=20).collect()
    tokens = {r[0]: [*words((r[1] or "").translate(UP)), "\n"] for r in rows}
    seen = Counter(t for d, w in [*tokens.items(), (None, tokens[0]), (3, tokens[3])] if teach(d) for t in w)
    total, types = sum(seen.values()), len(seen)
    for r in got:
        w = tokens[r.doc_id or 0]
        base = sum(math.log10((seen[t] + 0.5) / (total + 0.5 * (types + 1))) for t in w)
        assert (r.n_tokens, r.train_tokens, r.n_known) == (len(w), total, sum(seen[t] > 0 for t in w)) and r.base_score == pytest.approx(base)
        assert r.score < 0
    assert pitman_yor.score(nothing, teach).count() == 0


def test_seating_matches_its_conditional():
    logs, draw = pitman_yor.stirling_logs(0.5), np.random.default_rng(0)
    # two customers: S(2,1) = 1 - d, S(2,2) = 1
    tables = pitman_yor.seat(np.full(20_000, 2), np.full(20_000, 1.5), logs, 0.5, draw)
    assert tables.mean() - 1 == pytest.approx(1.5**2 / (1.5**2 + 0.5 * 1.5), abs=0.02)
    assert (pitman_yor.seat(np.array([0, 1, 500]), np.ones(3), logs, 0.5, draw) <= [0, 1, 500]).all()


def test_substring_dedup(docs, rows, nothing):
    got = {r.doc_id: r for r in lz_dedup.deduplicate(docs, block_rows=9).collect()}
    first = {tuple(words(rows[0][1])[i : i + 13]) for i in range(len(words(rows[0][1])) - 12)}  # the null id stands first with row 0's text
    for doc_id, text, *_ in rows:
        w = words(text)
        windows = [tuple(w[i : i + 13]) for i in range(len(w) - 12)]
        gone = {j for i, x in enumerate(windows) if x in first for j in range(i, i + 13)}
        first |= set(windows)
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        r = got[doc_id]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()), doc_id
    assert lz_dedup.deduplicate(nothing).count() == 0


def test_license_scan(spark, nothing):
    given = [
        (1, "x CC BY y\nAll rights reserved. all RIGHTS-reserved", "cc-by,reserved", "cc-by,reserved", 3, 1, 7),
        (2, "Permission is hereby granted, free of charge, to any person who is obtaining a copy of this software and documentation files", "", "mit", 0, None, None),
        (3, None, "", "", 0, None, None), (4, "", "", "", 0, None, None), (4, "the gnu general public license", "gpl", "gpl", 1, 2, 2), (None, "general public", "", "", 0, None, None),
    ]
    df = spark.createDataFrame([(a, b, "clash") for a, b, *_ in given], "doc_id long, text string, labels string")
    got = sorted((str(r.doc_id), r.n_base, str(r.first_word), str(r.last_word), r.base_labels, r.labels) for r in license_scan.scan(df).collect())
    assert got == sorted((str(g[0]), g[4], str(g[5]), str(g[6]), g[2], g[3]) for g in given)
    assert license_scan.scan(nothing).count() == 0


def test_decontamination(spark, docs, nothing):
    items = spark.createDataFrame([(7, "a train leaves Rome at 9 and covers 40 km before it meets another train from Oslo in Rome"), (8, None), (9, "too short")], "item_id long, text string")
    question = "so A train leaves? a train leaves Lima at 8 and covers 55 km before it meets another train from Bonn in {} ok"
    given = [(1, question.format("Lima")), (2, question.format("Paris").replace("train from Bonn", "bus from Bonn")), (3, None), (4, "nothing here at all"), (None, question.format("Lima"))]
    df = spark.createDataFrame([(a, b, "clash") for a, b in given], "doc_id long, text string, item_id string")
    got = {r.doc_id: r for r in decontaminate.leaks(df, items).collect()}
    assert set(got) >= {1, None} and got[1].n_changed == 4 and 3 not in got and 4 not in got
    assert {r.doc_id for r in decontaminate.remove_leaks(df, items).collect()} <= {2, 3, 4}
    assert decontaminate.leaks(nothing, items).count() == 0 and decontaminate.leaks(df, items.limit(0)).count() == 0


def test_mixing(docs, rows, nothing):
    plan = {r.source: r for r in mixture.plan(docs, max_repeats=1.2).collect()}
    tokens = Counter()
    for r in [*rows, (None, rows[0][1], None, None), rows[3]]:
        tokens[r[3]] += len(words(r[1]))
    assert sum(r.weight for r in plan.values()) == pytest.approx(1)
    assert max(r.quota / tokens[s] for s, r in plan.items() if tokens[s]) <= 1.2 + 1e-6
    mixed = mixture.mix_sources(docs, max_repeats=1.2)
    used = Counter()
    for r in mixed.collect():
        used[r.source] += len(words(r.text))
    assert mixed.columns == docs.columns and all(used[s] <= plan[s].quota for s in plan)
    assert mixture.mix_sources(docs, entropy=0.9).count() > 0 and mixture.mix_sources(nothing).count() == 0
