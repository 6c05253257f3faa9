"""Pair scores, gates and policies as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seguelake.functions.numeric import clip, lookup, mean_of, rounded

# Weights of the nine pair components.
COMPONENT_WEIGHTS = {
    "tempo": 0.17, "phrase": 0.13, "energy": 0.13, "bass": 0.13, "vocal": 0.08,
    "tension": 0.08, "style": 0.08, "context": 0.05, "harmonic": 0.15,
}
NEUTRAL = 0.5
# Review and fail limits of the pair rules.
LIMITS = {
    "tempo_pass": 6.0, "tempo_strategy": 10.0, "tempo_hard": 18.0, "tempo_octave": 2.5,
    "harmonic_review": 0.50, "harmonic_fail": 0.75, "vocal_review": 0.50, "vocal_fail": 0.70,
    "bass_review": 0.55, "bass_fail": 0.72, "phrase_review": 0.45, "phrase_fail": 0.35,
    "tension_review": 0.45, "tension_fail": 0.35,
}
# Recommendation limits.
ALLOW_CONFIDENCE, SUPPRESS_CONFIDENCE, REVIEW_RISK, SUPPRESS_RISK = 0.58, 0.28, 0.58, 0.82
# Score weights per planner mode.
MODE_WEIGHTS = {
    "smart": {"harmonic": 0.35, "bpm": 0.25, "energy": 0.20, "mixability": 0.20},
    "harmonic": {"harmonic": 0.55, "bpm": 0.15, "energy": 0.10, "mixability": 0.20},
    "bpm": {"harmonic": 0.15, "bpm": 0.55, "energy": 0.10, "mixability": 0.20},
}
SOUND_WEIGHT = 0.6
# Penalties and allowance per novelty mode.
NOVELTY = {
    "deterministic": (0.0, 0.0, 10**9), "conservative": (0.03, 0.02, 5), "balanced": (0.06, 0.04, 3),
    "fresh": (0.12, 0.08, 1), "exploratory": (0.15, 0.12, 0),
}
# score differences under which candidates count as tied, by novelty mode
TIE_WIDTH = {"deterministic": 0.0, "conservative": 0.02, "balanced": 0.02, "fresh": 0.02, "exploratory": 0.05}
STYLE_MARGIN = 0.15
BEAT_OPTIONS = (32, 64, 96, 128, 160, 192, 224, 256)
ACCEPT_BONUS, REJECT_PENALTY = 0.15, 0.40
EXIT_STRATEGIES = (
    "echo_out", "break_transition", "hard_cut", "reset", "tempo_ramp", "half_time_double_time_switch", "tool_mix",
)
BLEND_STRATEGIES = ("standard_blend", "short_blend", "phrase_aligned_blend")


def energy_fit(a: Column, b: Column) -> Column:
    return 1.0 - F.abs(a - b) / F.greatest(a, b, F.lit(1e-9)) * F.when(a.isNotNull() & b.isNotNull(), 1.0)


def shared_exposure(a: Column, b: Column) -> Column:
    """High only where both sides are; null if one is unmeasured."""
    return F.when(a.isNotNull() & b.isNotNull(), clip(F.least(a, b)))


def style_fit(a: Column, b: Column) -> Column:
    known = a.isNotNull() & b.isNotNull() & (a != "") & (b != "")
    return F.when(known, F.when(a == b, 1.0).otherwise(0.5))


def tension_fit(a: Column, b: Column) -> Column:
    return clip(1.0 - F.abs(a - b))


def mixability(parts: dict[str, Column]) -> Column:
    """Weighted sum of the components; an unmeasured one counts as neutral."""
    total = F.lit(0.0)
    for name, weight in COMPONENT_WEIGHTS.items():
        total = total + weight * F.coalesce(parts.get(name, F.lit(None)).cast("double"), F.lit(NEUTRAL))
    return total


def coverage_confidence(parts: dict[str, Column]) -> Column:
    present = F.lit(0)
    for name in COMPONENT_WEIGHTS:
        if name in parts:
            present = present + parts[name].isNotNull().cast("int")
    return rounded(present / len(COMPONENT_WEIGHTS) * 0.8, 2)


def missing_components(parts: dict[str, Column]) -> Column:
    names = [F.when(parts[n].isNull(), F.lit(n)) if n in parts else F.lit(n) for n in sorted(COMPONENT_WEIGHTS)]
    return F.array_compact(F.array(*names))


def pair_rules(gap, rel, harmonic=None, vocal=None, bass=None, phrase=None, tension=None) -> Column:
    """Struct of gates, block, review, penalty and flag names."""
    return F.struct(*[v.alias(k) for k, v in rule_columns(gap, rel, harmonic, vocal, bass, phrase, tension).items()])


def rule_columns(gap, rel, harmonic=None, vocal=None, bass=None, phrase=None, tension=None) -> dict[str, Column]:
    """What ``pair_rules`` puts together, as single columns.

    ``gap`` is the effective tempo step in percent and ``rel`` the tempo relation,
    both as plain columns because they are used many times.
    """
    none = F.lit(None).cast("double")
    harmonic, vocal, bass, phrase, tension = [none if x is None else x for x in (harmonic, vocal, bass, phrase, tension)]
    octave = (rel != "direct") & (gap <= LIMITS["tempo_octave"])
    tempo_case = (
        F.when(gap.isNull(), "tempo_unresolved")
        .when(octave, "octave_handling")
        .when(gap <= LIMITS["tempo_pass"], "")
        .when(gap <= LIMITS["tempo_strategy"], "tempo_gap")
        .when(gap <= LIMITS["tempo_hard"], "tempo_jump")
        .otherwise("tempo_extreme")
    )

    def two_step(value: Column, name: str, review: tuple, fail: tuple, rising: bool) -> tuple[Column, Column]:
        """Flag name and penalty; (limit, penalty) pairs."""
        bad = (value >= fail[0]) if rising else (value < fail[0])
        warn = (value >= review[0]) if rising else (value < review[0])
        flag = F.when(bad, f"{name}_fail").when(warn, f"{name}_review").otherwise("")
        cost = F.when(bad, fail[1]).when(warn, review[1]).otherwise(0.0)
        return flag, cost

    checks = [
        two_step(harmonic, "harmonic", (LIMITS["harmonic_review"], 0.08), (LIMITS["harmonic_fail"], 0.16), True),
        two_step(vocal, "vocal", (LIMITS["vocal_review"], 0.06), (LIMITS["vocal_fail"], 0.14), True),
        two_step(bass, "bass", (LIMITS["bass_review"], 0.06), (LIMITS["bass_fail"], 0.14), True),
        two_step(phrase, "phrase", (LIMITS["phrase_review"], 0.05), (LIMITS["phrase_fail"], 0.10), False),
        two_step(tension, "tension", (LIMITS["tension_review"], 0.04), (LIMITS["tension_fail"], 0.08), False),
    ]
    tempo_cost = lookup(
        tempo_case,
        {"tempo_unresolved": 0.04, "octave_handling": 0.08, "": 0.0, "tempo_gap": 0.10, "tempo_jump": 0.14, "tempo_extreme": 0.18},
    )
    penalty = tempo_cost
    for _, cost in checks:
        penalty = penalty + cost
    # asked of the flags one by one, since functions over arrays are interpreted row by row
    names = [tempo_case, *[f for f, _ in checks]]
    block = (tempo_case == "tempo_extreme") | (names[1] == "harmonic_fail") | (names[2] == "vocal_fail") | (names[3] == "bass_fail")
    review = F.lit(False)
    for flag in names:
        review = review | (flag != "")
    return {
        "relation": rel,
        "gap_pct": gap,
        "tempo_gate": F.when(tempo_case == "tempo_unresolved", "review")
        .when(tempo_case == "", "pass")
        .when(tempo_case == "tempo_extreme", "fail")
        .otherwise("strategy_dependent"),
        "harmonic_gate": F.when(harmonic.isNull(), "review")
        .when(harmonic >= LIMITS["harmonic_fail"], "fail")
        .when(harmonic >= LIMITS["harmonic_review"], "review")
        .otherwise("pass"),
        "standard_allowed": (tempo_case == "") & ~block,
        "hard_block": block,
        "review": review,
        "penalty": rounded(F.least(penalty, F.lit(0.45)), 4),
        "flags": F.filter(F.array(*names), lambda f: f != ""),
    }


def pair_risk(rules: Column, harmonic, vocal, bass, phrase, tension) -> Column:
    """Mean of the measured risks, the rule penalty and a hard block."""
    return clip(
        mean_of(
            clip(harmonic),
            clip(vocal),
            clip(bass),
            clip(1.0 - phrase),
            clip(1.0 - tension),
            clip(rules["penalty"] * 2.0),
            F.when(rules["hard_block"], 1.0),
        )
    )


def policy(confidence: Column, risk: Column, hard: Column, review: Column, severe: Column, score: Column) -> Column:
    """suppress, review_only or allow."""
    return (
        F.when(hard | severe | (confidence < SUPPRESS_CONFIDENCE), "suppress")
        .when((risk >= SUPPRESS_RISK) & (confidence < ALLOW_CONFIDENCE), "suppress")
        .when((score < 0.24) & (confidence < 0.45), "suppress")
        .when(review | (confidence < ALLOW_CONFIDENCE) | (risk >= REVIEW_RISK), "review_only")
        .otherwise("allow")
    )


def strategy(rules: Column, window_risk: Column, bridging: Column) -> Column:
    """Struct of strategy, feasibility and whether a standard blend is allowed."""
    gap, rel = rules["gap_pct"], rules["relation"]
    octave = (rel != "direct") & (gap <= LIMITS["tempo_octave"])
    calm = (rel == "direct") & (window_risk < 0.45)
    first = (
        F.when(gap.isNull(), "short_blend")
        .when(octave, "half_time_double_time_switch")
        .when(gap <= 2.0, "standard_blend")
        .when(gap <= 4.0, "short_blend")
        .when((gap <= 6.0) & calm, "phrase_aligned_blend")
        .when(gap <= 10.0, "tempo_ramp")
        .when((gap <= 18.0) & bridging, "break_transition")
        .when(gap <= 18.0, "echo_out")
        .when(bridging, "reset")
        .otherwise("hard_cut")
    )
    allowed = ~gap.isNull() & ~octave & ((gap <= 4.0) | ((gap <= 6.0) & calm)) & rules["standard_allowed"]
    swapped = F.when(
        ~rules["standard_allowed"] & first.isin(*BLEND_STRATEGIES),
        F.when(F.coalesce(gap, F.lit(0.0)) <= 10.0, "echo_out").otherwise("hard_cut"),
    ).otherwise(first)
    base = (
        F.when(gap.isNull(), F.array(F.lit("echo_out"), F.lit("tool_mix")))
        .when(octave, F.array(F.lit("tempo_ramp"), F.lit("echo_out")))
        .when(gap <= 2.0, F.array(F.lit("phrase_aligned_blend"), F.lit("short_blend")))
        .when(gap <= 4.0, F.array(F.lit("phrase_aligned_blend"), F.lit("standard_blend")))
        .when(gap <= 6.0, F.array(F.lit("short_blend"), F.lit("echo_out")))
        .when(gap <= 10.0, F.array(F.lit("echo_out"), F.lit("break_transition")))
        .when(gap <= 18.0, F.array(F.lit("hard_cut"), F.lit("reset")))
        .otherwise(F.array(F.lit("echo_out")))
    )
    widened = F.when(~rules["standard_allowed"], F.concat(base, F.array(F.lit("echo_out"), F.lit("hard_cut")))).otherwise(base)
    return F.struct(
        swapped.alias("strategy"),
        F.when(gap.isNull() | octave, "medium").when(gap <= 4.0, "high").when(gap <= 10.0, "medium").otherwise("low").alias("feasibility"),
        allowed.alias("standard_allowed"),
        F.filter(F.array_distinct(widened), lambda s: s != swapped).alias("alternatives"),
    )


def blend_profile(chosen: Column, bass: Column, vocal: Column) -> Column:
    return (
        F.when(chosen.isin(*EXIT_STRATEGIES), "plain_blend")
        .when(F.coalesce(bass, F.lit(0.0)) >= 0.45, "bass_swap")
        .when(F.coalesce(vocal, F.lit(0.0)) >= 0.22, "contour_blend")
        .when(chosen.isin("short_blend", "phrase_aligned_blend"), "tops_swap")
        .otherwise("plain_blend")
    )


def decision_class(score, confidence, rules, allowed, context, window_risk, harmonic, vocal, bass) -> Column:
    severe = F.lit(False)
    for r in (harmonic, vocal, bass):
        severe = severe | F.coalesce(r >= 0.72, F.lit(False))
    strong = (
        (score >= 0.72) & (confidence >= 0.55) & allowed & (rules["tempo_gate"] == "pass") & (rules["harmonic_gate"] == "pass")
        & (window_risk < 0.45) & (F.coalesce(context, F.lit(0.5)) >= 0.55) & ~severe
    )
    return (
        F.when(rules["hard_block"], "reject_standard_blend")
        .when(strong, "strong_candidate")
        .when((score < 0.45) | ((rules["tempo_gate"] == "fail") & severe), "reject_standard_blend")
        .when(~allowed & (score >= 0.55), "non_standard_strategy_required")
        .otherwise("review_required")
    )


def arc_energy(delta: Column, arc: Column) -> Column:
    """Reward of an energy change under a set shape."""
    return (
        F.when(arc == "off", 1.0)
        .when((arc == "build") & (delta >= -0.02), clip(0.6 + 4.0 * delta))
        .when(arc == "build", clip(0.6 + 8.0 * delta))
        .when(arc == "peak", clip(1.0 - 6.0 * F.abs(delta)))
        .otherwise(clip(1.0 - 5.0 * F.abs(delta)))
    )


def planner_score(mode: Column, harmonic: Column, bpm: Column, energy: Column, mix: Column, affinity=None, lift=None) -> Column:
    """Weighted transition score; sound and prior lift only count in smart mode."""
    parts = {"harmonic": harmonic, "bpm": bpm, "energy": energy, "mixability": mix}
    total = F.lit(0.0)
    for name, value in parts.items():
        total = total + lookup(mode, {m: w[name] for m, w in MODE_WEIGHTS.items()}) * value
    smart = mode == "smart"
    if affinity is not None:
        total = F.when(smart & affinity.isNotNull(), (1.0 - SOUND_WEIGHT) * total + SOUND_WEIGHT * affinity).otherwise(total)
    if lift is not None:
        total = F.when(smart & (lift != 1.0), clip(total * lift)).otherwise(total)
    return total


def novelty_penalty(edge_seen: Column, appearances: Column, exempt: Column, mode: str, edge_factor: int = 1) -> Column:
    edge_cost, item_cost, allowance = NOVELTY[mode]
    return F.when(F.coalesce(edge_seen, F.lit(False)), edge_cost * edge_factor).otherwise(0.0) + F.when(
        ~F.coalesce(exempt, F.lit(False)) & (F.coalesce(appearances, F.lit(0)) > allowance), item_cost
    ).otherwise(0.0)


def verdict_adjustment(verdict: Column) -> Column:
    return F.when(verdict == "yes", ACCEPT_BONUS).when(verdict == "no", -REJECT_PENALTY).otherwise(0.0)


def stepped_beats(verdict: Column, auditioned: Column, suggested: Column) -> Column:
    """One option up or down from the auditioned length, bounded by the options."""
    options = F.array(*map(F.lit, BEAT_OPTIONS))
    start = F.when(auditioned.isin(*BEAT_OPTIONS), auditioned).otherwise(suggested)
    at = F.array_position(options, start)
    moved = F.least(F.greatest(at + F.when(verdict == "longer", 1).otherwise(-1), F.lit(1)), F.lit(len(BEAT_OPTIONS)))
    change = F.coalesce(verdict.isin("longer", "shorter"), F.lit(False)) & (F.coalesce(at, F.lit(0)) > 0)
    return F.when(change, F.try_element_at(options, moved.cast("int"))).otherwise(suggested)


def anchored(score: Column, closeness: Column, weight: float = 0.35) -> Column:
    return F.when(closeness.isNull(), score).otherwise((1.0 - weight) * score + weight * closeness)


def contoured(score: Column, affinity: Column, target: Column, weight: float = 0.45, tolerance: float = 0.35) -> Column:
    """Pull towards a wanted jump size; ``target`` is a raw cosine."""
    fit = F.greatest(F.lit(0.0), 1.0 - F.abs(affinity - (target + 1.0) / 2.0) / tolerance)
    return F.when(affinity.isNull() | target.isNull(), score).otherwise((1.0 - weight) * score + weight * fit)
