"""Tempo arithmetic.  A tempo of zero or null counts as unmeasured."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seguelake.functions.numeric import clip, rounded

# Tempo multiples that count as the same pulse.
OCTAVES = {"direct": 1.0, "double_time_of_b": 2.0, "half_time_of_b": 0.5}
# Upper edges in percent and labels of the folded tempo step.
STEP_EDGES = ((2.0, "0-2%"), (4.0, "2-4%"), (6.0, "4-6%"), (10.0, "6-10%"))
STEP_REST = ">10%"
OCTAVE_SHARE = 0.1
# Simple metric ratios.
METRIC_RATIOS = {"1:2": 0.5, "2:3": 2 / 3, "3:4": 0.75, "1:1": 1.0, "4:3": 4 / 3, "3:2": 1.5, "2:1": 2.0}
# Weight of playing faster and slower than the native tempo.
FASTER, SLOWER = 0.765, 1.0


def known(bpm: Column) -> Column:
    return F.when(bpm != 0, bpm.cast("double"))


def variants(bpm: Column) -> Column:
    """The tempo at x1, x2 and x0.5."""
    return F.array(*[known(bpm) * f for f in OCTAVES.values()])


def _gaps(a: Column, b: Column) -> list[Column]:
    return [F.abs(known(a) - known(b) * f) for f in OCTAVES.values()]


def _by_nearest(a: Column, b: Column, values: list) -> Column:
    """The value standing for the nearest multiple; the first multiple wins ties."""
    direct, double, half = _gaps(a, b)
    return (
        F.when((direct <= double) & (direct <= half), values[0])
        .when(double <= half, values[1])
        .when(half.isNotNull(), values[2])
    )


def nearest_variant(a: Column, b: Column) -> Column:
    """The multiple of ``b`` nearest to ``a``."""
    return known(b) * _by_nearest(a, b, list(OCTAVES.values()))


def relation(a: Column, b: Column) -> Column:
    """Name of the nearest multiple, or ``unknown``."""
    return F.coalesce(_by_nearest(a, b, list(OCTAVES)), F.lit("unknown"))


def relative_distance(a: Column, b: Column) -> Column:
    """Least gap over the multiples of ``b``, as a share of ``a``."""
    gaps = _gaps(a, b)
    return F.when(gaps[0].isNotNull(), F.least(*gaps)) / known(a)


def fold(bpm: Column, low: float = 90.0) -> Column:
    """Shift by whole octaves into [low, 2*low)."""
    return known(bpm) / F.pow(F.lit(2.0), F.floor(F.log2(known(bpm) / low)))


def metric_relation(measured: Column, reference: Column, tolerance: float = 0.03) -> Column:
    """Nearest simple ratio of reference to measured tempo, or ``other``."""
    ratio = known(reference) / known(measured)
    near = F.array_min(
        F.array(*[F.struct(F.abs(ratio - r).alias("d"), F.lit(r).alias("r"), F.lit(n).alias("n")) for n, r in METRIC_RATIOS.items()])
    )
    return (
        F.when(ratio.isNull(), "unknown")
        .when(F.abs(ratio - near["r"]) / near["r"] <= tolerance, near["n"])
        .otherwise("other")
    )


def ratio_gap(a: Column, b: Column) -> Column:
    """Distance of b/a from 1 after folding the ratio by octaves into [0.67, 1.5]."""
    r = b / a
    folded = F.when(r > 1.5, r / F.pow(F.lit(2.0), F.ceil(F.log2(r / 1.5)))).when(
        r < 0.67, r * F.pow(F.lit(2.0), F.ceil(F.log2(0.67 / r)))
    ).otherwise(r)
    return F.when((a > 0) & (b > 0), F.abs(folded - 1.0)).otherwise(9.99)


def proximity(a: Column, b: Column, tolerance: float = 0.06) -> Column:
    """1 at equal tempo, 0 from twice the tolerance; 0.5 when unmeasured."""
    return F.coalesce(clip(1.0 - relative_distance(a, b) / (2.0 * tolerance)), F.lit(0.5))


def blend_fit(a: Column, b: Column, tolerance: float = 0.08) -> Column:
    """Like ``proximity`` but unmeasured stays null."""
    return clip(1.0 - relative_distance(a, b) / (2.0 * tolerance))


def crosses_octave(a: Column, b: Column) -> Column:
    return relation(a, b).isin("double_time_of_b", "half_time_of_b")


def succession_score(a: Column, b: Column, tolerance: float = 0.06) -> Column:
    """Proximity that keeps only a tenth when an octave jump is needed."""
    return proximity(a, b, tolerance) * F.when(crosses_octave(a, b), OCTAVE_SHARE).otherwise(1.0)


def step_bucket(a: Column, b: Column) -> Column:
    """Bucket of the folded percent step; null when unmeasured."""
    pct = relative_distance(a, b) * 100.0
    out = F.when(pct.isNull(), None)
    for edge, label in STEP_EDGES:
        out = out.when(pct < edge, label)
    return out.otherwise(STEP_REST)


def signed_step_pct(a: Column, b: Column) -> Column:
    return rounded((known(b) - known(a)) / known(a) * 100.0, 2)


def effective_step_pct(a: Column, b: Column) -> Column:
    return rounded(relative_distance(a, b) * 100.0, 2)


def in_range(bpm: Column, low: Column | None, high: Column | None) -> Column:
    """Closed range; an unmeasured tempo never matches, even without bounds."""
    ok = bpm.isNotNull()
    if low is not None:
        ok = ok & (low.isNull() | (bpm >= low))
    if high is not None:
        ok = ok & (high.isNull() | (bpm <= high))
    return F.coalesce(ok, F.lit(False))


def strain(rate: Column, faster: float = FASTER, slower: float = SLOWER) -> Column:
    """Discomfort of a playback rate; speeding up and slowing down weigh differently."""
    return F.when(rate > 1.0, faster * (rate - 1.0)).when(rate < 1.0, slower * (1.0 / rate - 1.0)).otherwise(0.0)


def octave_candidates(bpm: Column, exponents=(-2, -1, 0, 1, 2)) -> Column:
    return F.array(*[F.struct(F.lit(e).alias("octave"), (bpm * 2.0**e).alias("bpm")) for e in exponents])


def nearest_octave(reference: Column, bpm: Column, exponents=(-1, 0, 1)) -> Column:
    """(octave, bpm) of the nearest allowed multiple; small shifts win ties."""
    options = [
        F.struct(
            F.abs(reference - bpm * 2.0**e).alias("gap"),
            F.lit(abs(e)).alias("shift"),
            F.lit(e).alias("octave"),
            (bpm * 2.0**e).alias("bpm"),
        )
        for e in exponents
    ]
    best = F.array_min(F.array(*options))
    return F.struct(best["octave"].alias("octave"), best["bpm"].alias("bpm"))


def meeting_tempo(a: Column, b: Column, faster: float = FASTER, slower: float = SLOWER) -> Column:
    """Tempo at which both sides are equally strained."""
    low, high = F.least(a, b), F.greatest(a, b)
    root = F.sqrt((faster - slower) ** 2 * low * low + 4.0 * faster * slower * high * low)
    target = ((faster - slower) * low + root) / (2.0 * faster)
    return F.when(F.abs(high - low) <= 1e-12, low).otherwise(F.least(high, F.greatest(low, target)))
