"""Metrics, intervals and controls for ranked and rated data."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seguelake import grouping
from seguelake.functions import hashes
from seguelake.functions.numeric import rounded
from seguelake.operators.aggregates import share_below
from seguelake.session import cut_lineage

c = F.col


def boundary_metrics(df: DataFrame, predicted: str, truth: str, tolerances=(15.0, 30.0, 60.0)) -> DataFrame:
    """Coverage, error and hit rates per tolerance; missing predictions stay in the denominator."""
    d = df.select(F.abs(c(predicted) - c(truth)).alias("err"))
    q = grouping.quantiles(d, [], "err", {"median": 0.5, "p90": 0.9}).select(F.struct("median", "p90"))
    base = d.agg(
        F.count(F.lit(1)).alias("total"),
        F.count("err").alias("evaluated"),
        F.avg("err").alias("mae"),
        F.array(*[F.struct(F.lit(t).alias("tolerance"), F.count_if(c("err") <= t).alias("hits")) for t in tolerances]).alias("h"),
    )
    out = base.withColumn("q", q.scalar()).withColumn("h", F.explode("h"))
    return out.select(
        "total",
        "evaluated",
        F.try_divide(c("evaluated"), c("total")).alias("coverage"),
        "mae",
        "q.median",
        "q.p90",
        "h.tolerance",
        F.try_divide(c("h.hits"), c("evaluated")).alias("rate_evaluated"),
        F.try_divide(c("h.hits"), c("total")).alias("rate_all"),
    )


def _ordinal(d: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """(by, value, rows, rows with a smaller value) per distinct value."""
    cells = d.groupBy(*by, value).agg(F.count(F.lit(1)).alias(f"n_{name}"))
    crowded = grouping.large_groups(cells, by) is not None
    binned = grouping.quantile_bins(cells, by, value) if crowded else cells.withColumn("__qbin", F.lit(0))
    ran = grouping.running(binned, by, [value], [c("__qbin")], sums={"__run": c(f"n_{name}")})
    return ran.select(*by, value, f"n_{name}", (c("__run") - c(f"n_{name}")).alias(f"q_{name}"))


def rank_correlations(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Pearson, Spearman with average ranks and tau-b per group.

    No pair of rows is ever formed.  Two rows with different y ranks part at exactly
    one highest bit of the rank; for each bit the concordant minus discordant pairs
    are running counts along x inside the rows that share the higher bits.
    Fewer than three rows or a constant side gives null.
    """
    d = df.filter(c(x).isNotNull() & c(y).isNotNull()).select(*by, c(x).cast("double").alias("x"), c(y).cast("double").alias("y"))
    sizes = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("r"))
    ox, oy = _ordinal(d, by, "x", "x"), _ordinal(d, by, "y", "y")
    ties = lambda o, k: o.groupBy(*by).agg(F.sum(c(f"n_{k}") * (c(f"n_{k}") - 1) / 2).alias(f"tie_{k}"))
    cells = d.groupBy(*by, "x", "y").agg(F.count(F.lit(1)).alias("w")).join(ox, [*by, "x"]).join(oy, [*by, "y"])
    cells = cells.join(sizes.select(*by, "n"), by)
    middle = (c("n") + 1) / 2
    dx, dy = c("q_x") + (c("n_x") + 1) / 2 - middle, c("q_y") + (c("n_y") + 1) / 2 - middle
    moments = cells.groupBy(*by).agg(
        F.sum(c("w") * dx * dy).alias("xy"), F.sum(c("w") * dx * dx).alias("vx"), F.sum(c("w") * dy * dy).alias("vy")
    )
    bits = F.ceil(F.log2(c("n") + 1.0)).cast("int")
    levels = cells.select(*by, "x", "w", "q_y", F.explode(F.sequence(F.lit(0), bits)).alias("bit"))
    up = F.floor(c("q_y") / F.pow(F.lit(2.0), c("bit"))).cast("long")
    parts = levels.withColumn("one", up % 2).withColumn("head", F.floor(up / 2)).groupBy(*by, "bit", "head", "x").agg(
        F.sum(F.when(c("one") == 0, c("w")).otherwise(0)).alias("w0"), F.sum(F.when(c("one") == 1, c("w")).otherwise(0)).alias("w1")
    )
    keys = [*by, "bit", "head"]
    crowded = grouping.large_groups(parts, keys) is not None
    parts = grouping.quantile_bins(parts, keys, "x") if crowded else parts.withColumn("__qbin", F.lit(0))
    ran = grouping.running(parts, keys, ["x"], [c("__qbin")], sums={"r0": c("w0"), "r1": c("w1")})
    balance = ran.groupBy(*by).agg(F.sum(c("w1") * (c("r0") - c("w0")) - c("w0") * (c("r1") - c("w1"))).alias("bal"))
    out = sizes
    for part in (moments, balance, ties(ox, "x"), ties(oy, "y")):
        out = out.join(part, by)
    pairs = c("n") * (c("n") - 1) / 2
    ok = (c("n") >= 3) & (c("vx") > 1e-12) & (c("vy") > 1e-12)
    values = {"r": c("r"), "rho": c("xy") / F.sqrt(c("vx") * c("vy")), "tau": c("bal") / F.sqrt((pairs - c("tie_x")) * (pairs - c("tie_y")))}
    return out.select(*by, "n", *[F.when(ok, v).alias(k) for k, v in values.items()])


def rating_sessions(ratings: DataFrame, min_rated: int = 30) -> DataFrame:
    """ratings(session, pair, score, rating, comment, blind): one summary row per session."""
    d = ratings.filter(c("score").isNotNull() & c("rating").isNotNull())
    base = d.groupBy("session").agg(
        F.count(F.lit(1)).alias("rated"),
        F.count_if(F.coalesce("comment", F.lit("")) != "").alias("comments"),
        F.count_if("blind").alias("blind"),
        F.avg("score").alias("mean_score"),
        F.avg("rating").alias("mean_rating"),
        F.count_if((c("score") >= 0.7) & (c("rating") <= 2)).alias("false_positives"),
    )
    copies = d.groupBy("session", "pair").agg(F.count(F.lit(1)).alias("n")).groupBy("session").agg(F.sum(c("n") - 1).alias("duplicates"))
    out = base.join(copies, "session").join(grouping.quantiles(d, ["session"], "rating", {"median_rating": 0.5}), "session")
    out = out.join(rank_correlations(d, ["session"], "score", "rating").drop("n"), "session", "left")
    return out.withColumn("complete", c("rated") >= min_rated)


def rating_histogram(ratings: DataFrame) -> DataFrame:
    """(session, rating, n) per session, and over all sessions with a null session."""
    d = ratings.filter(c("score").isNotNull() & c("rating").isNotNull())
    per = d.groupBy("session", "rating").agg(F.count(F.lit(1)).alias("n"))
    return per.unionByName(per.groupBy("rating").agg(F.sum("n").alias("n")).select(F.lit(None).cast(per.schema["session"].dataType).alias("session"), "rating", "n"))


def rating_benchmark(ratings: DataFrame, min_sessions: int = 5, min_rated: int = 30) -> DataFrame:
    """One row over all sessions: counts, means, correlations, how many complete sessions are still wanted, and whether the ratings suffice for tuning."""
    d = ratings.filter(c("score").isNotNull() & c("rating").isNotNull())
    sizes = d.groupBy("session").agg(F.count(F.lit(1)).alias("n"))
    sessions = sizes.agg(F.count(F.lit(1)).alias("sessions"), F.count_if(c("n") >= min_rated).alias("complete"))
    whole = d.agg(
        F.count(F.lit(1)).alias("rated"), F.count_if(F.coalesce("comment", F.lit("")) != "").alias("comments"), F.avg("score").alias("mean_score"), F.avg("rating").alias("mean_rating"),
        F.count_if((c("score") >= 0.7) & (c("rating") <= 2)).alias("false_positives"),
    )
    one = lambda df: df.select(F.struct("*")).scalar()
    correlated = rank_correlations(d.withColumn("all", F.lit(1)), ["all"], "score", "rating").select("r", "rho", "tau")
    out = whole.withColumn("s", one(sessions)).withColumn("x", one(correlated)).select("*", "s.*", "x.*").drop("s", "x")
    wanted = F.greatest(F.lit(0).cast("long"), F.lit(min_sessions).cast("long") - c("complete"))
    return out.withColumn("wanted_sessions", wanted).withColumn("ready", wanted == 0)


def cohen_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Chance-corrected agreement over nominal labels; null when undefined."""
    cells = df.groupBy(c(a).alias("a"), c(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    left = cells.groupBy(c("a").alias("l")).agg(F.sum("n").alias("na"))
    right = cells.groupBy(c("b").alias("l")).agg(F.sum("n").alias("nb"))
    expected = left.join(right, "l").agg(F.sum(c("na") * c("nb"))).scalar()
    out = cells.agg(F.sum("n").alias("n"), F.sum(F.when(c("a") == c("b"), c("n")).otherwise(0)).alias("same"))
    out = out.withColumn("po", c("same") / c("n")).withColumn("pe", expected / (c("n") * c("n")))
    return out.select("n", F.when(F.abs(1 - c("pe")) >= 1e-12, (c("po") - c("pe")) / (1 - c("pe"))).alias("kappa"))


def interval_hits(engine: DataFrame, human: DataFrame, by: str, k: int, min_s: float = 4.0, width: float = 3600.0) -> DataFrame:
    """engine(by, eid, rank, start, end), human(by, start, end): top-k hit, mean best IoU, false positive rate."""
    left = grouping.explode_bins(engine, c("start"), c("end"), width)
    right = grouping.explode_bins(human.select(by, c("start").alias("hs"), c("end").alias("he")), c("hs"), c("he"), width)
    both = left.join(right, [by, "__cell"])
    overlap = F.greatest(F.lit(0.0), F.least("end", "he") - F.greatest("start", "hs"))
    union = (c("end") - c("start")) + (c("he") - c("hs")) - overlap
    best = both.groupBy("eid").agg(F.max(overlap).alias("overlap"), F.max(F.when(union > 0, overlap / union).otherwise(0.0)).alias("iou"))
    d = engine.join(best, "eid", "left").withColumn("hit", F.coalesce(c("overlap") >= min_s, F.lit(False)))
    return d.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_or((c("rank") <= k) & c("hit")).alias("top_hit"),
        F.avg(F.coalesce("iou", F.lit(0.0))).alias("mean_iou"),
        F.avg((~c("hit")).cast("double")).alias("fp_rate"),
    )


def case_ranks(scored: DataFrame, case: list[str], score: str, truth: Column) -> DataFrame:
    """Rank of the true pick per case: 1 + better, ties at their midrank.

    The true score is joined back and rows are counted against it, so a case is never sorted.
    """
    best = scored.groupBy(*case).agg(F.max(F.when(truth, c(score))).alias("__true"))
    d = scored.join(best, case)
    out = d.groupBy(*case).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(c(score) > c("__true")).alias("better"),
        F.count_if(c(score) == c("__true")).alias("ties"),
        F.max("__true").alias("__t"),
    )
    return out.filter(c("__t").isNotNull()).withColumn("rank", 1 + c("better") + (c("ties") - 1) / 2).drop("__t")


def ranking_metrics(ranks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """ranks(n, rank): mean percentile, top-1/5/10, MRR and the uniform baselines."""
    d = ranks.filter(c("n") >= 2)
    grouped = d.groupBy(*by) if by else d
    hit = lambda k: F.avg((c("rank") <= k).cast("double")).alias(f"top{k}")
    return grouped.agg(
        F.count(F.lit(1)).alias("cases"),
        F.avg((c("rank") - 1) / (c("n") - 1)).alias("percentile"),
        hit(1),
        hit(5),
        hit(10),
        F.avg(1.0 / c("rank")).alias("mrr"),
        F.avg(1.0 / c("n")).alias("uniform_top1"),
        F.avg(F.ln(c("n").cast("double"))).alias("uniform_nll"),
        F.avg(F.when(c("n") >= 5, (c("rank") == 1).cast("double"))).alias("top1_n5"),
    )


def interchangeable_top1(scored: DataFrame, case: list[str], score: str, order: str, tolerance: float = 0.04) -> DataFrame:
    """scored(case, item, score, is_true, bpm, key): top pick counts if it is the true one or mixes the same way."""
    from seguelake.functions import tempo

    facts = F.struct("item", "bpm", "key")
    per = scored.groupBy(*case).agg(
        F.min_by(facts, F.struct(-c(score), c(order))).alias("p"), F.max_by(facts, F.when(c("is_true"), F.lit(1))).alias("t")
    )
    same = (c("p.item") == c("t.item")) | (
        (c("p.key") == c("t.key")) & (tempo.relative_distance(c("t.bpm"), c("p.bpm")) <= tolerance)
    )
    return per.agg(F.count(F.lit(1)).alias("cases"), F.avg(F.coalesce(same, F.lit(False)).cast("double")).alias("rate"))


# Cumulative Poisson(1) probabilities of 0 to 7.
POISSON_CDF = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676, 0.99998975)


def bootstrap_interval(df: DataFrame, block: str, value: str, by: list[str], reps: int, seed: int, level: float = 0.95) -> DataFrame:
    """Percentile interval of a mean by resampling whole blocks with Poisson weights.

    Blocks are first reduced to (sum, count); replicates then add up weighted
    sums, combined on the map side.
    """
    blocks = df.groupBy(*by, block).agg(F.sum(value).alias("s"), F.count(value).alias("k"))
    drawn = blocks.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    u = F.pmod(F.xxhash64(F.lit(seed), c("rep"), c(block)), F.lit(2**31)) / F.lit(float(2**31))
    weight = sum((F.when(u >= p, 1).otherwise(0) for p in POISSON_CDF), F.lit(0))
    sums = drawn.select(*by, "rep", (weight * c("s")).alias("ws"), (weight * c("k")).alias("wk")).groupBy(*by, "rep").agg(
        F.try_divide(F.sum("ws"), F.sum("wk")).alias("stat")
    )
    tail = (1 - level) / 2
    out = sums.groupBy(*by).agg(
        F.percentile("stat", F.lit(tail)).alias("low"), F.percentile("stat", F.lit(1 - tail)).alias("high"), F.avg((c("stat") <= 0).cast("double")).alias("p_not_better")
    )
    point = blocks.groupBy(*by).agg((F.sum("s") / F.sum("k")).alias("estimate"), F.count(F.lit(1)).alias("blocks"))
    return out.join(point, by) if by else out.select("*").withColumn("pt", point.select(F.struct("*")).scalar()).select("low", "high", "p_not_better", "pt.*")


def dirichlet_priors(obs: DataFrame, bucket: str, buckets: list, context: str, alpha: float = 0.5, strength: float = 25.0) -> DataFrame:
    """Smoothed bucket probabilities per context on top of the smoothed global ones; null context is the global row."""
    per = [F.count_if(c(bucket) == b).alias(f"k{i}") for i, b in enumerate(buckets)]
    total = obs.agg(F.count(F.lit(1)).alias("n"), *per)
    share = F.array(*[(c(f"k{i}") + alpha) / (c("n") + alpha * len(buckets)) for i in range(len(buckets))])
    base = total.select("n", share.alias("p"))
    ctx = obs.filter(c(context).isNotNull()).groupBy(context).agg(F.count(F.lit(1)).alias("n"), *per)
    ctx = ctx.withColumn("g", base.select("p").scalar())
    mixed = F.array(*[(c(f"k{i}") + strength * c("g")[i]) / (c("n") + strength) for i in range(len(buckets))])
    both = ctx.select(c(context).alias("context"), "n", mixed.alias("p")).unionByName(base.select(F.lit(None).cast("string").alias("context"), "n", "p"))
    labels = F.array(*map(F.lit, buckets))
    return both.select("context", "n", F.explode(F.arrays_zip(labels.alias("bucket"), c("p").alias("p"))).alias("z")).select("context", "n", "z.bucket", "z.p")


def probabilistic_metrics(rows: DataFrame, probs: str, target: str, by: list[str]) -> DataFrame:
    """rows(probs ARRAY, target index): log loss, Brier score, accuracy and ten-bin calibration error."""
    p = c(probs)
    chosen = F.least(F.greatest(F.get(p, c(target)), F.lit(1e-12)), F.lit(1.0))
    conf = F.array_max(p)
    squares = F.aggregate(p, F.lit(0.0), lambda a, v: a + v * v)
    d = rows.select(
        *by,
        (-F.ln(chosen)).alias("nll"),
        (squares - 2 * F.get(p, c(target)) + 1).alias("brier"),
        conf.alias("conf"),
        (F.array_position(p, conf) - 1 == c(target)).cast("double").alias("hit"),
        F.ceil(conf * 10).alias("bin"),
    )
    cells = d.groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum("nll").alias("nll"), F.sum("brier").alias("brier"), F.sum("hit").alias("hit"), F.sum("conf").alias("conf")
    )
    grouped = cells.groupBy(*by) if by else cells
    return grouped.agg(
        F.sum("n").alias("n"),
        (F.sum("nll") / F.sum("n")).alias("nll"),
        (F.sum("brier") / F.sum("n")).alias("brier"),
        (F.sum("hit") / F.sum("n")).alias("top1"),
        (F.sum(F.abs(c("hit") - c("conf"))) / F.sum("n")).alias("ece"),
    )


def paired_loss_gate(losses: DataFrame, a: str, b: str, z: float = 1.64485) -> DataFrame:
    """Enable b over a when the one-sided upper bound of the mean loss change is below zero."""
    d = losses.select((c(b) - c(a)).alias("d")).agg(F.count("d").alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"))
    se = c("sd") / F.sqrt(c("n").cast("double"))
    ok = c("n") >= 2
    return d.select(
        "n",
        F.when(ok, c("mean")).otherwise(0.0).alias("mean_delta"),
        F.when(ok, c("mean") + z * se).otherwise(0.0).alias("upper"),
        F.coalesce(ok & (c("mean") + z * se < 0), F.lit(False)).alias("enabled"),
    )


def split_audit(rows: DataFrame, split: str, target: str, item: str, names: list[str]) -> DataFrame:
    """Total variation between target distributions and shared items, for each pair of splits; null where a split is empty."""
    cells = rows.groupBy(split, target).agg(F.count(F.lit(1)).alias("n"))
    wide = cells.groupBy(target).pivot(split, names).agg(F.sum("n")).na.fill(0)
    sizes = wide.agg(*[F.sum(s).alias(s) for s in names])
    members = rows.groupBy(item).agg(*[F.max((c(split) == s).cast("int")).alias(s) for s in names])
    total = sizes.select(F.struct("*")).scalar()
    out = None
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            tv = wide.withColumn("t", total).agg((F.sum(F.abs(F.try_divide(c(a), c(f"t.{a}")) - F.try_divide(c(b), c(f"t.{b}")))) / 2).alias("tv"))
            shared = members.agg(F.sum(c(a) * c(b)).alias("s"), F.least(F.sum(a), F.sum(b)).alias("m")).select(F.struct("s", "m"))
            row = tv.withColumn("x", shared.scalar()).select(
                F.lit(a).alias("left"), F.lit(b).alias("right"), "tv", c("x.s").alias("shared"), F.try_divide("x.s", "x.m").alias("shared_share")
            )
            out = row if out is None else out.unionByName(row)
    return out


def loss_shares(losses: DataFrame, by: str) -> DataFrame:
    """losses(by, model, loss) for L0, LH, LE, LHE, LHEI: two-block Shapley shares and flags."""
    models = ["L0", "LH", "LE", "LHE", "LHEI"]
    w = losses.groupBy(by).pivot("model", models).agg(F.avg("loss"))
    l0, lh, le, lhe, lhei = [c(m) for m in models]
    parts = {
        "rule": ((l0 - lh) + (le - lhe)) / (2 * l0),
        "similarity": ((l0 - le) + (lh - lhe)) / (2 * l0),
        "identity": (lhe - lhei) / l0,
        "residual": lhei / l0,
    }
    flags = [F.when(c(m) > l0, F.lit(f"{m}>L0")) for m in models[1:]] + [F.when(v < 0, F.lit(f"{n}<0")) for n, v in parts.items()]
    return w.filter(l0 > 0).select(by, *[v.alias(n) for n, v in parts.items()], F.array_join(F.array_compact(F.array(*flags)), ",").alias("flags"))


def joint_losses(selection: DataFrame, ordering: DataFrame, by: str) -> DataFrame:
    """selection and ordering (by, model, loss, universe): sums per model, for groups whose two losses come from one universe.

    A group stays out if its universes differ or a model is missing on either side; ``joint`` and
    ``refused`` groups are told apart by the column ``reason``.
    """
    side = lambda df, name: df.select(by, "model", c("loss").alias(name), c("universe").alias(f"{name}_universe"))
    both = side(selection, "selection").join(side(ordering, "ordering"), [by, "model"], "full")
    gaps = F.count_if(c("selection").isNull() | c("ordering").isNull())
    worlds = F.size(F.array_distinct(F.flatten(F.array(F.collect_set("selection_universe"), F.collect_set("ordering_universe")))))  # five models a group
    state = both.groupBy(by).agg(F.when(gaps > 0, "missing_model").when(worlds > 1, "other_universe").alias("reason"))
    return both.join(state, by).select(by, "model", F.when(c("reason").isNull(), c("selection") + c("ordering")).alias("loss"), "reason")


def log_factorials(top: DataFrame) -> DataFrame:
    """(k, lf) with lf = ln k! up to the single number in ``top``."""
    numbers = top.select(F.explode(F.sequence(F.lit(0), top[top.columns[0]].cast("int"))).alias("k"))
    d = numbers.withColumn("lnk", F.when(c("k") > 0, F.ln(c("k").cast("double"))).otherwise(0.0))
    return grouping.running(d, [], ["k"], [F.floor(c("k") / 65536)], sums={"lf": c("lnk")}).select("k", "lf")


def selection_baseline(cases: DataFrame, n: str, m: str) -> DataFrame:
    """Log loss of a uniform subset, ln C(n, m)."""
    table = log_factorials(cases.agg(F.max(n)))
    pick = lambda name: table.select(c("k").alias(f"__{name}"), c("lf").alias(name))
    d = cases.withColumn("__d", c(n) - c(m))
    out = d.join(pick("fn"), d[n] == c("__fn")).join(pick("fm"), c(m) == c("__fm")).join(pick("fd"), c("__d") == c("__fd"))
    return out.withColumn("nll", c("fn") - c("fm") - c("fd")).drop("__d", "__fn", "__fm", "__fd", "fn", "fm", "fd")


def ablation_ladder(cases: DataFrame, case: list[str], truth: Column, rungs: list[tuple[str, dict[str, float]]]) -> DataFrame:
    """Same cases under nested weight sets: metrics per rung and change from the previous rung."""
    score = [sum((w * c(k) for k, w in ws.items()), F.lit(0.0)) for _, ws in rungs]
    each = lambda make: [make(i) for i in range(len(rungs))]
    best = cases.filter(truth).groupBy(*case).agg(*each(lambda i: F.max(score[i]).alias(f"__t{i}")))
    d = cases.select(*case, *each(lambda i: score[i].alias(f"__s{i}"))).join(best, case)
    counts = d.groupBy(*case).agg(
        F.count(F.lit(1)).alias("n"),
        *each(lambda i: F.struct(
            F.lit(i).alias("step"), F.lit(rungs[i][0]).alias("rung"), F.count_if(c(f"__s{i}") > c(f"__t{i}")).alias("better"), F.count_if(c(f"__s{i}") == c(f"__t{i}")).alias("ties"), F.max(f"__t{i}").alias("t")
        ).alias(f"__r{i}")),
    )
    ranks = counts.filter(c("n") >= 2).select("n", F.explode(F.array(*each(lambda i: c(f"__r{i}")))).alias("r")).filter(c("r.t").isNotNull())
    ranks = ranks.select("n", "r.step", "r.rung", (1 + c("r.better") + (c("r.ties") - 1) / 2).alias("rank"))
    # cases of one size and rank count alike
    cells = cut_lineage(ranks.groupBy("step", "rung", "n", "rank").agg(F.count(F.lit(1)).alias("w")).withColumn("pct", (c("rank") - 1) / (c("n") - 1)))
    share = lambda k: (F.sum(F.when(c("rank") <= k, c("w")).otherwise(0)) / F.sum("w")).alias(f"top{k}")
    out = cells.groupBy("step", "rung").agg(F.sum("w").alias("cases"), share(1), share(5))
    shares = cells.groupBy("step", "pct").agg(F.sum("w").alias("w"))
    ran = grouping.running(shares, ["step"], ["pct"], [F.floor(c("pct") * 4096)], sums={"upto": c("w")})
    at = lambda place, name: F.min(F.when(c("upto") > place, c("pct"))).alias(name)
    middle = (c("cases") - 1) / 2
    medians = ran.join(F.broadcast(out.select("step", "cases")), "step").groupBy("step").agg(at(F.floor(middle), "__lo"), at(F.ceil(middle), "__hi"))
    out = out.join(medians, "step").withColumn("median_pct", (c("__lo") + c("__hi")) / 2).drop("__lo", "__hi")
    w = Window.partitionBy(F.lit(0)).orderBy("step")  # one row per rung
    return out.withColumn("delta", c("median_pct") - F.lag("median_pct").over(w))


def _tail_part(v: np.ndarray, m: np.ndarray, chosen: int, observed: int, part: int, parts: int) -> tuple[float, float]:
    """Share of one part of the frequencies in P(chosen many, sum at most the observed one) and P(chosen many), with every row picked by a coin."""
    n = int(m.sum())
    step = int(np.gcd.reduce(v - v[0])) or 1
    place = (v - v[0]) // step  # sums of places tell sums of values apart, given how many were chosen
    limit = (observed - chosen * int(v[0])) // step
    ends = np.cumsum(m)
    low = int((place * np.diff(np.minimum(ends, chosen), prepend=0)).sum())
    high = int((place * np.diff(np.maximum(ends - (n - chosen), 0), prepend=0)).sum())
    # Hoeffding: sums or numbers beyond these distances weigh less than 1e-21, far below what a double tells apart
    mean, far = chosen * float((place * m).sum()) / n, 5.0 * float(place[-1]) * min(chosen, n - chosen) ** 0.5 + 1.0
    low, high = max(low, int(np.floor(mean - far))), min(high, int(np.ceil(mean + far)))
    width, count = high - low + 1, min(n + 1, int(np.ceil(5.0 * n**0.5)) + 1)
    upto = min(max(limit - low + 1, 0), width)
    coin = chosen / n
    turns = np.arange(count)
    below = several = 0.0
    for b in range(part, width, parts):
        angle = 2 * np.pi * (b * place % width) / width
        # coefficient of "chosen many" in the product of (1 - coin + coin * y * x^place)^m at one x
        log = np.zeros(count, complex)
        with np.errstate(divide="ignore", invalid="ignore"):
            for turn, many in zip(angle, m):
                log += many * np.log((1 - coin) + coin * np.exp(1j * (2 * np.pi * turns / count + turn)))
            term = np.where(np.isneginf(log.real), 0.0, np.exp(log))
        found = (term * np.exp(-2j * np.pi * (turns * chosen % count) / count)).sum() / count
        if b == 0:
            several, kernel = float(found.real), upto / width
        else:
            around = lambda k: np.exp(-2j * np.pi * (b * k % width) / width)
            kernel = around(low % width) * (1 - around(upto)) / (1 - around(1)) / width
        below += float((found * kernel).real)
    return below, several


def exact_assignment(df: DataFrame, test: str, value: str, control: str, decimals: int = 6, parts: int = 64) -> DataFrame:
    """(test, n, controls, delta, p): exact one-sided test of treated mean minus control mean over all assignments.

    p is the share of all ways to choose as many controls whose delta is at least the observed
    one.  Spark counts equal values per test; the generating function of (chosen, sum), which
    covers all assignments without listing any, is turned back at the frequencies of the sum,
    ``parts`` tasks a test.  Numbers and sums reach as far from their means as a double can
    tell from nothing, so the work grows with distinct values x rows x range; p is right to
    about 1e-9.  Values count in units of 10^-decimals; rows without value or flag are left out;
    delta and p are null without a row on either side.
    """
    unit = 10**decimals
    rows = df.filter(c(value).isNotNull() & c(control).isNotNull()).select(test, F.round(c(value) * unit).cast("long").alias("v"), c(control).cast("int").alias("k"))
    counts = rows.groupBy(test, "v").agg(F.count(F.lit(1)).alias("m"), F.sum("k").alias("k"))
    kind = df.schema[test].dataType.simpleString()

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("v")
        v, m, k = (group[x].to_numpy(np.int64) for x in ("v", "m", "k"))
        n, chosen = int(m.sum()), int(k.sum())
        out = {test: [group[test].iloc[0]], "n": [n], "controls": [chosen], "delta": [None], "below": [None], "several": [None]}
        if 0 < chosen < n:
            observed, total = int((v * k).sum()), int((v * m).sum())
            below, several = _tail_part(v, m, chosen, observed, int(group["part"].iloc[0]), parts)  # a small control sum is a large delta
            out.update(below=[below], several=[several], delta=[((total - observed) / (n - chosen) - observed / chosen) / unit])
        return pd.DataFrame(out)

    shared = counts.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    shared = shared.repartition(parts, test, "part")  # few rows with much work each: a fixed number keeps them in separate tasks
    solved = shared.groupBy(test, "part").applyInPandas(solve, f"`{test}` {kind}, n long, controls long, delta double, below double, several double")
    share = F.least(F.greatest(F.sum("below") / F.sum("several"), F.lit(0.0)), F.lit(1.0))
    p = F.when(F.sum("several").isNotNull(), share)
    return solved.groupBy(test).agg(F.max("n").alias("n"), F.max("controls").alias("controls"), F.max("delta").alias("delta"), p.alias("p"))


def permutation_test(df: DataFrame, block: str, x: str, y: str, key: str, reps: int, seed: int) -> DataFrame:
    """Correlation of x and y against shuffles of y inside each block; p = (hits + 1) / (reps + 1).

    A shuffle is two numberings of the same rows, by key and by hash, joined on the
    number; large blocks are numbered in hash bins.
    """
    base = df.select(block, key, c(x).cast("double").alias("x"), c(y).cast("double").alias("y"))
    fixed = grouping.position(base, [block], [key], [F.floor(c(key) / 65536)], "pos").select(block, "pos", "x")
    copies = base.select(block, key, "y").withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    copies = copies.withColumn("h", F.xxhash64(F.lit(seed), c("rep"), c(key)))
    drawn = grouping.position(copies, [block, "rep"], ["h", key], [F.shiftright("h", 52)], "pos").select(block, "rep", "pos", "y")
    null = drawn.join(fixed, [block, "pos"]).groupBy("rep").agg(F.corr("x", "y").alias("r"))
    actual = base.agg(F.corr("x", "y").alias("r")).scalar()
    out = null.withColumn("__a", actual).agg(F.max("__a").alias("stat"), F.count_if(F.abs("r") >= F.abs("__a")).alias("hits"), F.count(F.lit(1)).alias("reps"))
    return out.withColumn("p", (c("hits") + 1) / (c("reps") + 1))


def conformal_sets(calib: DataFrame, test: DataFrame, alphas: list[float]) -> DataFrame:
    """calib(case, p_true), test(case, p, is_true): coverage and size of prediction sets per alpha."""
    d = calib.select((1 - c("p_true")).alias("s"), "case")
    n = d.agg(F.count(F.lit(1))).scalar()
    ranked = grouping.position(d, [], ["s", "case"], [F.floor(c("s") * 4096)], "pos").withColumn("n", n)
    wanted = F.array(
        *[F.struct(F.lit(a).alias("alpha"), F.least(F.ceil((c("n") + 1) * (1 - a)), c("n")).alias("at")) for a in alphas]
    )
    cuts = ranked.withColumn("w", F.explode(wanted)).filter(c("pos") == c("w.at")).select(F.struct(c("w.alpha").alias("alpha"), c("s").alias("q")).alias("z"))
    cut_list = cuts.agg(F.collect_list("z")).scalar()
    rows = test.withColumn("cuts", cut_list).withColumn("z", F.explode("cuts"))
    kept = rows.withColumn("keep", c("p") >= 1 - c("z.q"))
    per = kept.groupBy(c("z.alpha").alias("alpha"), "case").agg(F.count_if("keep").alias("size"), F.bool_or(c("keep") & c("is_true")).alias("hit"))
    return per.groupBy("alpha").agg(
        F.count(F.lit(1)).alias("cases"), F.avg(c("hit").cast("double")).alias("coverage"), F.avg("size").alias("mean_size"), F.count_if(c("size") == 0).alias("empty")
    )


def fixed_k_reference(sizes: DataFrame, n: str, ks: list[int]) -> DataFrame:
    """Coverage and mean size of random top-k sets."""
    d = sizes.groupBy(n).agg(F.count(F.lit(1)).alias("w")).withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    size = F.least("k", n)
    return d.groupBy("k").agg(
        (F.sum(c("w") * size / c(n)) / F.sum("w")).alias("coverage"), (F.sum(c("w") * size) / F.sum("w")).alias("mean_size")
    )


def _steps(df: DataFrame, by: str, order: str, item: str, bins) -> DataFrame:
    def step(d: DataFrame, window) -> DataFrame:
        return d.withColumn("b", F.lead(item).over(window()))

    return grouping.windowed(df, [by], [order], bins, 1, step).filter(c("b").isNotNull()).select(by, c(item).alias("a"), "b")


def _short_orders(orders: DataFrame, by: str, item: str) -> DataFrame:
    """A row per short group: sizes, correlation, rows (p, item, q) by p, and ``moves``, the places by p in the order of q."""
    d = orders.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(c("p") == c("q")).alias("same_slot"), F.corr("p", "q").alias("r"), F.array_sort(F.collect_list(F.struct("p", item, "q"))).alias("rows")
    )
    moves = F.transform(F.array_sort(F.transform("rows", lambda x, i: F.struct(x["q"].alias("q"), i.alias("i")))), lambda x: x["i"])
    d = d.withColumn("moves", moves)
    steps = F.zip_with(F.slice("moves", F.lit(2), F.size("moves") - 1), F.slice("moves", F.lit(1), F.size("moves") - 1), lambda x, y: x - y)
    return d.withColumn("steps", steps)


def _matching(values: Column, test) -> Column:
    return F.size(F.filter(values, test)).cast("long")


def reconstruction_of_orders(orders: DataFrame, by: str, item: str, bins: list[Column]) -> DataFrame:
    """``sequence_reconstruction`` of one table (by, item, p, q) in which an item of a group has one place ``p`` in the rebuilt order and one place ``q`` in the real one.

    Short groups are counted inside one row; ``bins`` are written on a column ``position``.
    """

    def short(d: DataFrame) -> DataFrame:
        d = _short_orders(d, by, item).filter(c("n") >= 2)
        kept = _matching(c("steps"), lambda x: x == 1)
        turned = F.aggregate(
            F.transform("moves", lambda x, i: _matching(F.slice("moves", i + 2, F.size("moves")), lambda y: y < x)), F.lit(0).cast("long"), lambda total, x: total + x
        )
        tau = F.when(c("n") >= 3, 1 - 4.0 * turned / (c("n") * (c("n") - 1)))
        return d.select(by, (c("n") - 1).alias("pairs"), kept.alias("kept"), tau.alias("tau")).withColumn("pairs_pct", rounded(c("kept") * 100.0 / c("pairs"), 4)).select(by, "pairs", "kept", "pairs_pct", "tau")

    def long(d: DataFrame) -> DataFrame:
        side = lambda place: d.select(by, item, c(place).alias("position"))
        return sequence_reconstruction(side("p"), side("q"), by, "position", item, bins).select(by, "pairs", "kept", "pairs_pct", "tau")

    return grouping.by_size(orders, [by], short, long, grouping.row_limit(orders))


def agreement_of_orders(orders: DataFrame, by: str, item: str, bins, reps: int, seed: int) -> DataFrame:
    """``order_agreement`` of one table (by, item, p, q) as for ``reconstruction_of_orders``; short groups are shuffled inside one row."""

    def short(d: DataFrame) -> DataFrame:
        d = _short_orders(d, by, item)
        drawn = lambda rep: F.array_sort(F.transform("rows", lambda x: F.struct(F.xxhash64(F.lit(seed), rep, c(by), x[item]).alias("h"), x[item].alias("item"), x["q"].alias("q"))))
        hits = lambda rep: _matching(F.transform(drawn(rep), lambda x, i: x["q"] == i + 1), lambda hit: hit)
        d = d.withColumn("hits", F.array_sort(F.transform(F.sequence(F.lit(1), F.lit(reps)), hits)))
        at = 0.95 * (reps - 1)
        low, high, part = int(at), min(int(at) + 1, reps - 1), at - int(at)
        total = F.aggregate("hits", F.lit(0).cast("long"), lambda acc, x: acc + x)
        pairs = lambda test: F.when(c("n") >= 2, _matching(c("steps"), test))
        return d.select(
            by, "n", "same_slot", "r", pairs(lambda x: x == 1).alias("pairs_exact"), pairs(lambda x: F.abs(x) == 1).alias("pairs_either"),
            (total / reps).alias("control_mean"), (F.get("hits", F.lit(low)) * (1 - part) + F.get("hits", F.lit(high)) * part).alias("control_p95"),
        )

    def long(d: DataFrame) -> DataFrame:
        side = lambda place: d.select(by, item, c(place).alias("position"))
        return order_agreement(side("p"), side("q"), by, "position", item, bins, reps, seed)

    return grouping.by_size(orders, [by], short, long, grouping.row_limit(orders))


def sequence_reconstruction(built: DataFrame, real: DataFrame, by: str, order: str, item: str, bins: list[Column]) -> DataFrame:
    """Share of real neighbour pairs present in the rebuilt order, per group."""
    pairs = _steps(real, by, order, item, bins).distinct()
    kept = pairs.join(_steps(built, by, order, item, bins).distinct().withColumn("k", F.lit(1)), [by, "a", "b"], "left")
    share = kept.groupBy(by).agg(F.count(F.lit(1)).alias("pairs"), F.count("k").alias("kept"))
    both = built.select(by, item, c(order).alias("p")).join(real.select(by, item, c(order).alias("q")), [by, item])
    tau = rank_correlations(both, [by], "p", "q").select(by, "tau")
    return share.withColumn("pairs_pct", rounded(c("kept") * 100.0 / c("pairs"), 4)).join(tau, by, "left")


def library_wide_rank(cases: DataFrame, library: DataFrame, value: str, truth: str, bins: int = 4096) -> DataFrame:
    """cases(case, target, truth value): share of the whole library scored strictly above the true item.

    The score is -|value - target|, so library rows nearer to the target than the true
    item are counted from the library's running distribution, not by scoring every pair.
    """
    cells = library.groupBy(c(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ran = grouping.running(cells, [], ["v"], [F.floor(c("v"))], sums={"cum": c("n")}).withColumn("g", F.lit(0))
    total = library.agg(F.count(F.lit(1))).scalar()
    d = cases.withColumn("gap", F.abs(c(truth) - c("target"))).withColumn("g", F.lit(0))
    from seguelake.operators.joins import asof

    # strictly inside (target - gap, target + gap)
    low = asof(d.withColumn("v", c("target") - c("gap")), ran.select("g", "v", "cum"), "g", "v", 1.0, {"c_low": "cum"}, first_if_before=False).drop("v", "mark_t")
    nudge = F.lit(1e-9)
    high = asof(low.withColumn("v", c("target") + c("gap") - nudge), ran.select("g", "v", "cum"), "g", "v", 1.0, {"c_high": "cum"}, first_if_before=False)
    out = high.withColumn("better", F.greatest(F.coalesce("c_high", F.lit(0)) - F.coalesce("c_low", F.lit(0)), F.lit(0)))
    return out.withColumn("share", c("better") / total).select("case", "better", "share")


def stratified_eval(ranks: DataFrame, mix: str, weight: str, base: float) -> DataFrame:
    """ranks(mix, weight, pct): mean percentile per weight inside terciles of the base-weight percentile."""
    per = ranks.groupBy(mix, weight).agg(F.avg("pct").alias("pct"))
    ref = per.filter(c(weight) == base).select(mix, rounded(c("pct"), 9).alias("ref"))
    n = ref.agg(F.count(F.lit(1))).scalar()
    third = grouping.position(ref, [], ["ref", mix], [F.floor(c("ref") * 4096)], "pos").withColumn("n", n)
    # ntile(3): the first (n mod 3) parts are one longer
    size, extra = F.floor(c("n") / 3), c("n") % 3
    head = (size + 1) * extra
    tile = F.when(c("pos") <= head, F.ceil(c("pos") / (size + 1))).otherwise(extra + F.ceil((c("pos") - head) / size))
    return per.join(third.select(mix, tile.cast("int").alias("tercile")), mix).groupBy("tercile", weight).agg(
        F.count(F.lit(1)).alias("mixes"), F.avg("pct").alias("pct")
    )


def order_agreement(built: DataFrame, played: DataFrame, by: str, order: str, item: str, bins, reps: int, seed: int) -> DataFrame:
    """Same-slot count, kept neighbour pairs and position correlation, with a shuffled control."""

    def compare(left: DataFrame, keys: list[str]) -> DataFrame:
        joined = left.join(played.select(by, item, c(order).alias("q")), [by, item])
        return joined.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(c("p") == c("q")).alias("same_slot"), F.corr("p", "q").alias("r"))

    actual = compare(built.select(by, item, c(order).alias("p")), [by])
    copies = built.select(by, item).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    copies = copies.withColumn("h", F.xxhash64(F.lit(seed), c("rep"), c(by), c(item)))
    shuffled = grouping.position(copies, [by, "rep"], ["h", item], [F.shiftright("h", 52)], "p")
    control = compare(shuffled, [by, "rep"]).groupBy(by).agg(F.avg("same_slot").alias("control_mean"), F.percentile("same_slot", F.lit(0.95)).alias("control_p95"))
    real = _steps(played, by, order, item, bins).distinct()
    kept = _steps(built, by, order, item, bins).distinct()
    either = kept.select(by, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = (
        real.join(kept.withColumn("k", F.lit(1)), [by, "a", "b"], "left")
        .withColumn("lo", F.least("a", "b")).withColumn("hi", F.greatest("a", "b"))
        .join(either.select(by, c("a").alias("lo"), c("b").alias("hi"), F.lit(1).alias("e")), [by, "lo", "hi"], "left")
        .groupBy(by).agg(F.count("k").alias("pairs_exact"), F.count("e").alias("pairs_either"))
    )
    return actual.join(pairs, by, "left").join(control, by)


def complementarity(rows: DataFrame, track: str, exits: str, entries: str, key: str, rotations: int) -> DataFrame:
    """Correlation of exit and entry shares, each minus its track mean, against rotations of the pairing."""
    means = rows.groupBy(track).agg(F.avg(exits).alias("me"), F.avg(entries).alias("mn"))
    d = rows.join(means, track).select(c(key).alias("key"), (c(exits) - c("me")).alias("x"), (c(entries) - c("mn")).alias("y"))
    placed = grouping.position(d, [], ["key"], [F.floor(c("key") / 65536)], "pos").withColumn("n", d.agg(F.count(F.lit(1))).scalar())
    turned = placed.select("y", "pos", "n", F.explode(F.sequence(F.lit(0), F.lit(rotations))).alias("turn"))
    # turns are spread evenly over the ring
    moved = turned.select("y", "turn", (F.pmod(c("pos") - 1 + F.floor(c("turn") * c("n") / (rotations + 1)), c("n")) + 1).alias("pos"))
    stats = placed.select("x", "pos").join(moved, "pos").groupBy("turn").agg(F.corr("x", "y").alias("r"))
    return stats.agg(
        F.max(F.when(c("turn") == 0, c("r"))).alias("r"),
        F.avg(F.when(c("turn") > 0, c("r"))).alias("control_mean"),
        F.max(F.when(c("turn") > 0, F.abs("r"))).alias("control_max"),
    )


def percentile_rank(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Left-insertion position over n - 1; 0.5 for fewer than two values."""
    d = share_below(df.filter(c(value).isNotNull()), by, value, "__below")
    return grouping.attach(d, by, __n=F.count(F.lit(1))).withColumn(
        "pct_rank", F.when(c("__n") < 2, 0.5).otherwise(rounded(c("__below") / (c("__n") - 1), 3))
    ).drop("__below", "__n")
