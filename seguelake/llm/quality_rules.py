"""Quality rules with risk-controlled thresholds.

A fixed base rule rejects short and self-repeating texts.  Further rules reject
a text whose measure exceeds a cutoff.  All cutoffs of a stratum are selected together
on labelled good documents that pass the base rule.  A hashed quarter of them sets
the scale of each measure, its largest value there (at least the last of CUTOFFS); a
text's worst scaled measure is then compared with one level.  On the other good
documents the level walks from the most lenient to the strictest and is accepted
while the exact binomial test rejects "more than ``risk`` of the good documents are
lost by any rule" at level ``delta / strata``; the walk stops at the first failure, so
walking needs no further correction.  The cutoffs are the level times the scales.  They
lose at most ``risk`` of a stratum's good documents, with probability ``1 - delta``
over all strata.  Strata with fewer good documents than a test needs are tested as
one pool, and the promise then holds for the pool's mixture.

Nulls and odd cases: a null or empty text has no words and fails the base rule;
null strata form a stratum of their own; labels other than 0 and 1, labels of
unknown ids and null ids teach nothing; repeated rows are judged alike; a stratum
without labelled good documents, or in a pool with too few, gets no cutoff, so only the
base rule applies (``uncovered`` lists the latter); without labels the same holds
everywhere; empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seguelake.llm.statistics import document_counts, labelled
from seguelake.session import cut_lineage

MEASURES = {
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "capitals": "n_upper / greatest(word_chars, 1)",
    "marks": "n_marks / greatest(n_words, 1)",
    "digits": "n_digits / greatest(word_chars, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "lines": "n_dup_lines / greatest(n_lines, 1)",
    "echoes": "n_echo / greatest(n_words, 1)",
    "long_words": "n_long / greatest(n_words, 1)",
}
CUTOFFS = tuple(round(0.95 * 0.82**k, 6) for k in range(24))
LEVELS = tuple(round(4 * 0.9**k, 6) for k in range(32))  # in units of the measures' scales
SCALE_FOLDS, FOLD_SEED = 4, 7  # one fold of the good documents sets the scales, the others test
BROADCAST_STRATA = 20_000


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def binomial_tail(k: int, n: int, rate: float) -> float:
    """P(X <= k) for X binomial(n, rate)."""
    if k >= n:
        return 1.0
    logs = [
        math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(rate) + (n - i) * math.log1p(-rate) for i in range(k + 1)
    ]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def strictest(exceeding: Sequence[int], n: int, rate: float, level: float) -> int | None:
    """Index of the last cutoff accepted by fixed-sequence testing, or None.  ``exceeding`` goes from lenient to strict."""
    accepted = None
    for i, k in enumerate(exceeding):
        # beyond twice the allowed count the test cannot pass; it also keeps the sum short
        if k > 2 * n * rate + 20 or binomial_tail(int(k), int(n), rate) > level:
            break
        accepted = i
    return accepted


def least_rows(risk: float, level: float) -> int:
    """How many good documents a test needs to pass when none is lost."""
    return math.ceil(math.log(level) / math.log1p(-risk))


def thresholds(counts: DataFrame, labels: DataFrame, stratum: str, risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """One row per stratum with labelled good documents.

    ``__stratum``, a map from measure to cutoff, the number of good documents its test had and whether the stratum
    was tested in the pool of small strata.  Without a cutoff the map is empty.
    """
    good = labelled(counts, labels, "quality").filter((F.col("__label") == 1) & ~base_failed())
    fold = F.pmod(F.xxhash64("doc_id", F.lit(FOLD_SEED)), F.lit(SCALE_FOLDS)) == 0
    measured = good.select(F.col(stratum).alias("__key"), fold.alias("scales"), *[F.expr(e).cast("double").alias(m) for m, e in MEASURES.items()])
    sizes = cut_lineage(measured.groupBy("__key").agg(F.count_if(~F.col("scales")).alias("n")))
    strata = max(1, sizes.count())
    level = delta / strata
    sizes = sizes.select(F.col("__key").alias("__stratum"), (F.col("n") < least_rows(risk, level)).alias("__pooled"))
    small = F.broadcast(sizes) if strata <= BROADCAST_STRATA else sizes
    placed = measured.join(small, measured["__key"].eqNullSafe(small["__stratum"])).drop("__stratum")
    placed = cut_lineage(placed.withColumn("__key", F.when(~F.col("__pooled"), F.col("__key"))))
    scale = placed.groupBy("__pooled", "__key").agg(*[F.greatest(F.max(F.when(F.col("scales"), F.col(m))), F.lit(CUTOFFS[-1])).alias(f"top_{m}") for m in MEASURES])
    scale = cut_lineage(scale.withColumnsRenamed({"__pooled": "__p", "__key": "__k"}))
    lines = F.broadcast(scale) if strata <= BROADCAST_STRATA else scale
    own = (F.col("__pooled") == F.col("__p")) & F.col("__key").eqNullSafe(F.col("__k"))
    worst = F.greatest(*[F.col(m) / F.col(f"top_{m}") for m in MEASURES])
    levels = F.array(*[F.lit(c) for c in LEVELS])
    tested = placed.filter(~F.col("scales")).join(lines, own).select("__pooled", "__key", F.size(F.filter(levels, lambda c: worst > c)).alias("over"))
    tally = tested.groupBy("__pooled", "__key", "over").agg(F.count(F.lit(1)).alias("n"))
    steps, walk = len(LEVELS), LEVELS

    def choose(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        # level i (lenient first) is exceeded by values over at least steps - i of them
        exceeding = [int(rows.n[rows.over >= steps - i].sum()) for i in range(steps)]
        at = strictest(exceeding, int(rows.n.sum()), risk, level)
        return pd.DataFrame({"__pooled": [bool(rows["__pooled"].iloc[0])], "__key": [rows["__key"].iloc[0]], "__tested": [int(rows.n.sum())], "__level": [None if at is None else walk[at]]})

    kind = counts.schema[stratum].dataType.simpleString()
    found = tally.groupBy("__pooled", "__key").applyInPandas(choose, f"__pooled boolean, __key {kind}, __tested long, __level double")
    found = found.join(scale, own)
    pairs = [x for m in MEASURES for x in (F.lit(m), F.col("__level") * F.col(f"top_{m}"))]
    cutoffs = F.when(F.col("__level").isNotNull(), F.create_map(*pairs)).otherwise(F.create_map().cast("map<string,double>"))
    found = found.select(F.col("__pooled").alias("__shared"), "__key", "__tested", cutoffs.alias("__cutoffs"))
    meet = (F.col("__pooled") == F.col("__shared")) & (F.col("__pooled") | F.col("__stratum").eqNullSafe(F.col("__key")))
    out = sizes.join(F.broadcast(found) if strata <= BROADCAST_STRATA else found, meet, "left")
    return out.select("__stratum", F.coalesce("__cutoffs", F.create_map().cast("map<string,double>")).alias("__cutoffs"), F.coalesce("__tested", F.lit(0)).alias("__tested"), "__pooled")


def uncovered(limits: DataFrame) -> DataFrame:
    """The strata of ``thresholds`` to which only the base rule applies; strata without labelled good documents are not among its rows."""
    return limits.filter(F.size("__cutoffs") == 0).select(F.col("__stratum").alias("stratum"), F.col("__tested").alias("tested"), F.col("__pooled").alias("pooled"))


def judge(counts: DataFrame, limits: DataFrame, stratum: str) -> DataFrame:
    """Add ``base_failed``, ``rejected_by`` and ``kept`` to rows of counts."""
    if limits.count() <= BROADCAST_STRATA:
        limits = F.broadcast(limits)
    joined = counts.join(limits, counts[stratum].eqNullSafe(limits["__stratum"]), "left")
    over = [F.when(F.expr(e) > F.try_element_at("__cutoffs", F.lit(m)), F.lit(m)) for m, e in MEASURES.items()]
    reasons = F.array_compact(F.array(*over))
    out = joined.withColumns({"base_failed": base_failed(), "rejected_by": reasons}).drop("__stratum", "__cutoffs", "__tested", "__pooled")
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))


def assess(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """Counts and verdict of every document.  The counts are derived from the texts once."""
    counts = cut_lineage(document_counts(docs, keep=("doc_id", stratum)))
    limits = cut_lineage(thresholds(counts, labels, stratum, risk, delta))
    return judge(counts, limits, stratum)


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """The documents that pass, with all their columns.

    Counts are derived twice, for the cutoffs and for the verdict, so that no text is shuffled.
    """
    limits = cut_lineage(thresholds(document_counts(docs, keep=("doc_id", stratum)), labels, stratum, risk, delta))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"), docs["text"], docs[stratum].alias("__group"))
    verdicts = judge(document_counts(rows, keep=("__row", "__group")), limits, "__group")
    return verdicts.filter("kept").select("__row.*")
