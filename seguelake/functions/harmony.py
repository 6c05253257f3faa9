"""Wheel-of-keys arithmetic.

A code such as ``8A`` is parsed once by ``key_index``; everything else is integer
arithmetic on that index (twice the number, plus one for mode B).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seguelake.functions.numeric import clip, lookup, rounded

# Compatibility and base risk per relation.
RELATION_SCORE = {
    "exact": 1.0, "relative_major_minor": 0.85, "adjacent_same_mode": 0.85,
    "cautious": 0.6, "risky": 0.15, "unknown": 0.5,
}
RELATION_RISK = {
    "exact": 0.05, "relative_major_minor": 0.15, "adjacent_same_mode": 0.15,
    "cautious": 0.4, "risky": 0.8, "unknown": 0.5,
}
UNMEASURED_CONFIDENCE = 0.5
LOW_CONFIDENCE = 0.15
CODE = r"^\s*(\d+)\s*([AB])$"


def key_index(code: Column) -> Column:
    """2 * number + (mode is B); null when the code is not 1-12 with A or B."""
    n = F.regexp_extract(code, CODE, 1).try_cast("int")
    return F.when(n.between(1, 12), n * 2 + F.when(code.endswith("B"), 1).otherwise(0))


def number(key: Column) -> Column:
    return F.shiftright(key, 1)


def mode(key: Column) -> Column:
    return F.when(key % 2 == 1, "B").when(key % 2 == 0, "A")


def distance(a: Column, b: Column) -> Column:
    """Steps around the wheel, 0 to 6."""
    d = F.abs(number(a) - number(b))
    return F.when(d > 6, 12 - d).otherwise(d)


def relation(a: Column, b: Column) -> Column:
    d, same = distance(a, b), a % 2 == b % 2
    return (
        F.when(d.isNull(), "unknown")
        .when((d == 0) & same, "exact")
        .when(d == 0, "relative_major_minor")
        .when((d == 1) & same, "adjacent_same_mode")
        .when((d == 2) & same, "cautious")
        .otherwise("risky")
    )


def least_confidence(a: Column, b: Column) -> Column:
    return F.least(F.coalesce(a, F.lit(UNMEASURED_CONFIDENCE)), F.coalesce(b, F.lit(UNMEASURED_CONFIDENCE)))


def trusted_relation(a: Column, b: Column, confidence: Column) -> Column:
    return F.when(confidence < LOW_CONFIDENCE, "unknown").otherwise(relation(a, b))


def compatibility(a: Column, b: Column, conf_a: Column, conf_b: Column) -> Column:
    conf = least_confidence(conf_a, conf_b)
    base = lookup(trusted_relation(a, b, conf), RELATION_SCORE)
    return rounded(base * conf + 0.5 * (1.0 - conf), 4)


def risk(a: Column, b: Column, conf_a: Column, conf_b: Column, exposure: Column) -> Column:
    conf = least_confidence(conf_a, conf_b)
    base = lookup(trusted_relation(a, b, conf), RELATION_RISK)
    shown = F.coalesce(clip(exposure), F.lit(0.5))
    return rounded(clip(base * (0.5 + shown) + 0.2 * (1.0 - conf)), 4)


def warning(a: Column, b: Column, conf_a: Column, conf_b: Column, exposure: Column) -> Column:
    conf = least_confidence(conf_a, conf_b)
    rel = trusted_relation(a, b, conf)
    shown = F.coalesce(clip(exposure), F.lit(0.5))
    return (
        F.when((rel == "risky") & (shown > 0.4), "exposed_key_clash")
        .when(rel == "risky", "masked_key_clash")
        .when(conf < 0.3, "verify_key")
        .otherwise("")
    )


def angle_features(key: Column, confidence: Column) -> Column:
    """sin, cos, mode flag, confidence and missing flag of a key."""
    theta = (number(key) - 1) * (2.0 * 3.141592653589793 / 12.0)
    missing = key.isNull()
    zero = F.lit(0.0)
    return F.when(missing, F.array(zero, zero, zero, zero, F.lit(1.0))).otherwise(
        F.array(
            F.sin(theta),
            F.cos(theta),
            F.when(key % 2 == 1, 1.0).otherwise(0.0),
            F.coalesce(confidence, F.lit(0.0)),
            zero,
        )
    )


def fifths_distance(shift_a: Column, shift_b: Column) -> Column:
    """Semitone difference as steps on the circle of fifths; unknown is 6."""
    steps = F.pmod((shift_a - shift_b) * 7, F.lit(12))
    return F.coalesce(F.least(steps, F.lit(12) - steps).cast("double"), F.lit(6.0))
