"""Nulls, ties, gaps and invariants on hand-made rows, and brute-force checks where SQL is no oracle."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from seguelake.functions import harmony, scoring, tempo, text
from seguelake.operators import evaluation, joins, pairs, quality, series, vectors
from seguelake.plans.set_batch import SetOptions, build_sets
from seguelake.sources import formats

c = F.col
def bins():
    return [F.floor(c("pos") / 64)]


def one(spark, **cols):
    return spark.range(1).select(*[v.alias(k) for k, v in cols.items()]).first()


def test_unmeasured_tempo(spark):
    none, zero, x = F.lit(None).cast("double"), F.lit(0.0), F.lit(120.0)
    r = one(spark, a=tempo.proximity(none, x), b=tempo.blend_fit(zero, x), c=tempo.step_bucket(none, x), d=tempo.in_range(none, None, None), e=tempo.relation(x, F.lit(61.0)))
    assert (r["a"], r["b"], r["c"], r["d"], r["e"]) == (0.5, None, None, False, "double_time_of_b")


def test_key_codes(spark):
    k = lambda s: harmony.key_index(F.lit(s))
    r = one(spark, a=k("13A"), b=k("A"), c=k("8C"), up=harmony.relation(k("6A"), k("8A")), down=harmony.relation(k("8A"), k("6A")), wrap=harmony.distance(k("12B"), k("1B")))
    assert (r["a"], r["b"], r["c"]) == (None, None, None)
    assert r["up"] == r["down"] == "cautious" and r["wrap"] == 1


def test_unknown_confidence_counts_half(spark):
    k = harmony.key_index(F.lit("8A"))
    none = F.lit(None).cast("double")
    r = one(spark, s=harmony.compatibility(k, k, none, none), low=harmony.trusted_relation(k, k, F.lit(0.1)))
    assert r["s"] == 0.75 and r["low"] == "unknown"


def test_duration_bucket_ties_go_down(spark):
    r = one(spark, a=series.duration_bucket(F.lit(48.0)), b=series.duration_bucket(F.lit(48.1)))
    assert (r["a"], r["b"]) == (32, 64)


def test_policy_order(spark):
    p = lambda conf, risk, hard, review, score: scoring.policy(F.lit(conf), F.lit(risk), F.lit(hard), F.lit(review), F.lit(False), F.lit(score))
    r = one(spark, a=p(0.9, 0.0, True, False, 0.9), b=p(0.2, 0.0, False, False, 0.9), c=p(0.5, 0.1, False, False, 0.9), d=p(0.9, 0.1, False, False, 0.9), e=p(0.44, 0.1, False, False, 0.2))
    assert [r[x] for x in "abcde"] == ["suppress", "suppress", "review_only", "allow", "suppress"]


def test_placeholders_and_clocks(spark):
    f = lambda s: text.is_placeholder(F.lit(s))
    r = one(spark, a=f("?? -"), b=f("Unreleased ID"), c=f("Idioteque"), d=text.seconds_of_clock(F.lit("1:02:03")), e=text.seconds_of_iso(F.lit("PT4M")), g=text.seconds_of_iso(F.lit("4M")))
    assert (r["a"], r["b"], r["c"], r["d"], r["e"], r["g"]) == (True, True, False, 3723, 240, None)


def test_gap_breaks_a_pair(spark):
    d = spark.createDataFrame([("m", 1, 10), ("m", 2, None), ("m", 3, 11), ("m", 5, 12), ("m", 6, 12)], "mix string, pos int, track int")
    assert pairs.adjacency_pairs(d, "mix", "pos", "track", bins()).count() == 0
    audit = {r["kind"]: r["n"] for r in pairs.adjacency_audit(d, "mix", "pos", "track", bins()).collect()}
    assert audit == {"missing_item": 2, "gap": 1, "same_item": 1}


def test_same_day_is_not_history(spark):
    mixes = spark.createDataFrame([(1, 7, "2020-01-01"), (2, 7, "2020-01-01"), (3, 7, "2020-02-01")], "mix long, dj long, d string").withColumn("day", F.to_date("d"))
    slots = spark.createDataFrame([(1, 5), (2, 6), (3, 5)], "mix long, track long")
    got = {r["mix"]: (r["prior_sets"], r["window_sets"], r["prior_tracks"]) for r in joins.strict_history(mixes, slots, 10).collect()}
    assert got == {1: (0, 0, 0), 2: (0, 0, 0), 3: (2, 0, 2)}


def test_constant_curve_is_one_half(spark):
    d = spark.createDataFrame([("a", 1.0), ("a", 1.0)], "k string, v double")
    for mode in ("minmax", "robust"):
        assert {r["x"] for r in series.normalized(d, "k", "v", mode, "x").collect()} == {0.5}


def test_repeat_starts_a_new_run(spark):
    items = [1, 2, 3, 1, 4, 5, None, 6, 7, 8]
    d = spark.createDataFrame([("m", i + 1, x, x is not None) for i, x in enumerate(items)], "mix string, pos int, item int, qualified boolean")
    got = series.contiguous_runs(d, "mix", "pos", bins(), ["item"]).orderBy("pos").collect()
    runs = [tuple(r["item"] for r in g) for _, g in itertools.groupby(got, key=lambda r: r["run"])]
    assert runs == [(1, 2, 3), (1, 4, 5), (6, 7, 8)]


def test_monotone_anchors_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(g, float(t), int(p)) for g in range(4) for t, p in enumerate(rng.permutation(9))]
    got = series.monotone_anchors(spark.createDataFrame(rows, "g int, t double, pos int"), "g").collect()
    for g in range(4):
        seq = [p for x, _, p in rows if x == g]
        best = max(len(s) for n in range(10) for s in itertools.combinations(seq, n) if list(s) == sorted(s))
        mine = [r["pos"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["t"])]
        assert mine == sorted(mine) and len(mine) == best


def test_neighbours_with_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 40)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(5, 6))
    x = np.concatenate([m + 0.1 * rng.normal(size=(60, 6)) for m in centres])
    d = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<double>")
    got = {(r["q"], r["rank"]): r["t"] for r in vectors.knn_join(d, d, 3, exclude_self=True).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = np.round(u @ u.T, 12)
    np.fill_diagonal(sims, -np.inf)
    for q in range(len(x)):
        want = sorted(range(len(x)), key=lambda t: (-sims[q, t], t))[:3]
        assert [got[q, r] for r in (1, 2, 3)] == want


def test_tau_and_rho_with_ties(spark):
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 8, 40), rng.integers(0, 4, 40)
    d = spark.createDataFrame([("g", float(a), int(b)) for a, b in zip(x, y)], "g string, x double, y int")
    r = evaluation.rank_correlations(d, ["g"], "x", "y").first()
    i, j = np.triu_indices(40, 1)
    sx, sy = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
    assert r["tau"] == pytest.approx((sx * sy).sum() / np.sqrt((sx != 0).sum() * (sy != 0).sum()))
    assert r["r"] == pytest.approx(np.corrcoef(x, y)[0, 1])


def test_bootstrap_is_repeatable_and_brackets(spark):
    d = spark.createDataFrame([(i // 3, "a", float(i % 7)) for i in range(120)], "block int, g string, v double")
    a = evaluation.bootstrap_interval(d, "block", "v", ["g"], 200, 1).first()
    b = evaluation.bootstrap_interval(d.repartition(5), "block", "v", ["g"], 200, 1).first()
    assert a["low"] == pytest.approx(b["low"]) and a["low"] < a["estimate"] < a["high"]


def test_decoys_hold_the_true_item_once(spark):
    universe = spark.range(50).select(F.lit(0).alias("pool"), c("id").alias("item"))
    cases = spark.range(30).select(c("id").alias("case"), F.lit(0).alias("pool"), (c("id") % 50).alias("true_item"))
    rows = vectors.decoy_pools(cases, universe, 8, 3).groupBy("case").agg(F.count("*").alias("n"), F.count_distinct("item").alias("d"), F.count_if("is_true").alias("t")).collect()
    assert len(rows) == 30 and all(r["n"] == r["d"] == 8 and r["t"] == 1 for r in rows)


def test_split_keeps_groups_whole(spark):
    d = spark.range(400).select((c("id") % 40).alias("mix"), "id")
    s = vectors.grouped_split(d, "mix", seed=4)
    assert s.groupBy("mix").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
    assert {r["split"]: r["n"] for r in s.groupBy("split").agg(F.count_distinct("mix").alias("n")).collect()} == {"train": 28, "valid": 6, "test": 6}


def test_sets_respect_locks_and_never_repeat(spark):
    rows = [(i, 100.0 + i, 4 + i % 6, 0.9, i / 20, 0.3, 0.2, "s", f"a{i}", f"r{i // 4}") for i in range(16)]
    tracks = spark.createDataFrame(rows, "track long, bpm double, key int, key_conf double, energy double, bass double, vocal double, style string, artist string, release string")
    requests = spark.createDataFrame([(1, 3), (2, 5)], "req long, start long")
    pool = requests.select("req").join(tracks.select("track"))
    locks = spark.createDataFrame([(2, 3, 15)], "req long, slot int, track long")
    plan = build_sets(requests, pool, tracks, SetOptions(slots=4), locks=locks).collect()
    for req, first in ((1, 3), (2, 5)):
        mine = [r["track"] for r in sorted((r for r in plan if r["req"] == req), key=lambda r: r["slot"])]
        assert len(mine) == len(set(mine)) == 4 and mine[0] == first
    assert [r["track"] for r in plan if r["req"] == 2 and r["slot"] == 3] == [15]


def test_fingerprint_ignores_order(spark):
    d = spark.range(200).select("id", (c("id") * 3 % 7).alias("x"))
    a, b = formats.fingerprint(d).first(), formats.fingerprint(d.repartition(7).orderBy(F.rand(1))).first()
    assert a == b and formats.fingerprint(d.withColumn("x", c("x") + 1)).first() != a


def test_bad_embeddings_reject_the_catalogue(spark):
    good = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "id string, vec array<double>")
    assert formats.load_embeddings(good, "id", "vec").count() == 2
    bad = good.unionByName(spark.createDataFrame([("c", [0.0, 0.0])], "id string, vec array<double>"))
    with pytest.raises(Exception, match="rejected"):
        formats.load_embeddings(bad, "id", "vec").collect()


def test_strict_catalogue_fails_closed(spark):
    albums = spark.createDataFrame([(1, 3, "x")], "album long, n_tracks int, creator string")
    rows = spark.createDataFrame([(1, 1, 5, "t", None), (1, 3, 6, "u", "y")], "album long, position int, song long, title string, artist string")
    with pytest.raises(ValueError, match="positions_not_contiguous"):
        quality.normalize_catalog(albums, rows)
    assert quality.normalize_catalog(albums, rows, strict=False)["review"].count() == 1


def test_corrupt_reports_are_counted(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"mix_id":"m","results":[{"youtube_id":"y","track_id":"t"}]}\n')
    (tmp_path / "b.json").write_text("{broken\n")
    (tmp_path / "._c.json").write_text("{shadow\n")
    results, _, corrupt = formats.scan_reports(spark, str(tmp_path))
    assert results.count() == 1 and corrupt.first()["corrupt"] == 1
