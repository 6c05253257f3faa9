"""Set roles of tracks and their fit to a context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seguelake import grouping
from seguelake.functions.numeric import clip, rounded

c = F.col

# Linear role weights over the curve features; b is the offset.
ROLE_WEIGHTS = {
    "opener": {"e_start": -0.8, "e_mean": -0.5, "slope": 0.4, "sustain": -0.4, "b": 0.9},
    "builder": {"slope": 0.9, "e_mean": 0.2, "sustain": -0.2, "b": 0.25},
    "bridge": {"windows": 0.7, "sustain": -0.3, "dip": 0.2, "b": 0.35},
    "peak": {"e_mean": 0.6, "sustain": 0.7, "bass": 0.4, "b": -0.5},
    "reset": {"dip": 0.7, "e_mean": -0.4, "slope": -0.2, "b": 0.35},
    "closer": {"slope": -0.8, "e_end": -0.5, "b": 0.7},
    "tool": {"short": 0.8, "windows": 0.4, "b": 0.0},
}
FEATURES = ("e_start", "e_end", "e_mean", "slope", "sustain", "dip", "bass", "windows", "short")
# Target lines per role (energy from, energy to, bass, vocal).
ROLE_TARGETS = {
    "opener": (0.20, 0.45, 0.35, 0.45), "builder": (0.40, 0.72, 0.55, 0.30), "bridge": (0.45, 0.58, 0.42, 0.35),
    "peak": (0.72, 0.92, 0.75, 0.20), "reset": (0.35, 0.22, 0.30, 0.35), "closer": (0.58, 0.32, 0.45, 0.50), "tool": (0.35, 0.50, 0.40, 0.25),
}
CROWD_SHIFT = {"low": -0.10, "medium": 0.0, "high": 0.10, "descending": -0.06}
VENUE_SHIFT = {"club": 0.0, "festival": 0.05}


def curve_features(frames: DataFrame, windows: DataFrame, by: str, bins) -> DataFrame:
    """frames(by, t, rms, bass), windows(by, score): nine features in about [0, 1]; under ten frames all are 0.5."""
    known = frames.filter(c("rms").isNotNull())
    base = known.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg("rms").alias("m"), F.min("rms").alias("lo"), F.avg("bass").alias("bass"), F.max("t").alias("last"))
    base = base.join(grouping.quantiles(known, [by], "rms", {"p95": 0.95}), by).withColumn("top", c("p95") + 1e-9)
    fifth = F.greatest(F.lit(1), F.floor(c("n") / 5))
    placed = grouping.position(known, [by], ["t"], bins, "i").select(by, "rms", "i").join(base.select(by, "n", "top"), by)
    ends = placed.groupBy(by).agg(
        F.avg(F.when(c("i") <= fifth, c("rms") / c("top"))).alias("e_start"),
        F.avg(F.when(c("i") > c("n") - fifth, c("rms") / c("top"))).alias("e_end"),
        F.avg((c("rms") / c("top") > 0.8).cast("double")).alias("sustain"),
    )
    d = base.join(ends, by).join(windows.groupBy(by).agg(F.avg("score").alias("windows")), by, "left")
    values = {
        "e_start": c("e_start"), "e_end": c("e_end"), "e_mean": c("m") / c("top"), "slope": clip((c("e_end") - c("e_start")) * 2 + 0.5),
        "sustain": c("sustain"), "dip": clip((c("m") - c("lo")) / c("top")), "bass": F.coalesce("bass", F.lit(0.5)),
        "windows": F.coalesce("windows", F.lit(0.5)), "short": clip(1 - c("last") / 240.0),
    }
    return d.select(by, "n", *[F.when(c("n") < 10, 0.5).otherwise(v).alias(f"f_{k}") for k, v in values.items()])


def set_function(features: DataFrame, wanted: str | None) -> DataFrame:
    """Role with the largest score, softmax confidence, near-equal roles and fit to the wanted role."""

    def score(role: str) -> Column:
        total = F.lit(ROLE_WEIGHTS[role]["b"] + (0.2 if role == wanted else 0.0))
        for k, w in ROLE_WEIGHTS[role].items():
            if k != "b":
                total = total + w * c(f"f_{k}")
        return total

    # the earlier role wins an exact tie, so the order number is negated
    entries = F.array(*[F.struct(rounded(score(r), 9).alias("s"), F.lit(-i).alias("o"), F.lit(r).alias("role")) for i, r in enumerate(ROLE_WEIGHTS)])
    d = features.withColumn("scores", entries).withColumn("top", F.array_max("scores"))
    spread = F.aggregate("scores", F.lit(0.0), lambda a, x: a + F.exp(x["s"] - c("top")["s"]))
    near = F.filter("scores", lambda x: (x["role"] != c("top")["role"]) & (x["s"] >= 0.8 * c("top")["s"]) & (x["s"] > 0))
    out = d.withColumn("role", c("top")["role"]).withColumn("confidence", 1.0 / spread)
    out = out.withColumn("secondary", F.array_join(F.array_sort(F.transform(near, lambda x: x["role"])), ","))
    if wanted:
        mine = F.filter("scores", lambda x: x["role"] == wanted)[0]["s"]
        fit = F.when(c("role") == wanted, 0.8).otherwise(rounded(clip(mine / (c("top")["s"] + 1e-9)) * 0.8, 2))
        out = out.withColumn("fit", fit)
    return out.drop("scores", "top", *[f"f_{k}" for k in FEATURES])


def context_fit(frames: DataFrame, tracks: DataFrame, by: str, bins, profiles: list[dict]) -> DataFrame:
    """frames(by, t, rms, bass, vocal), tracks(by, style): mean fit of every track to each profile's target line.

    A profile has name, role, crowd, venue, hour and styles.  The few profiles are
    literals exploded per frame; energy is min-max scaled per track.
    """
    placed = grouping.position(frames, [by], ["t"], bins, "__i")
    stats = frames.groupBy(by).agg(
        F.count(F.lit(1)).alias("__n"), F.min("rms").alias("__lo"), F.max("rms").alias("__hi"), F.avg("rms").alias("__mr"),
        F.avg("bass").alias("__mb"), F.avg("vocal").alias("__mv"),
    )
    d = placed.join(stats, by)
    flat = F.coalesce(c("__hi") - c("__lo") < 1e-9, F.lit(True))
    energy = F.when(flat, 0.5).otherwise(clip((F.coalesce("rms", "__mr") - c("__lo")) / (c("__hi") - c("__lo"))))
    bass = F.coalesce(clip(F.coalesce("bass", "__mb")), F.lit(0.5))
    vocal = F.coalesce(clip(F.coalesce("vocal", "__mv")), F.lit(0.35))
    d = d.select(by, energy.alias("e"), bass.alias("ba"), vocal.alias("vo"), F.when(c("__n") > 1, (c("__i") - 1) / (c("__n") - 1)).otherwise(0.0).alias("ramp"), *[F.col(f"__m{x}") for x in "rbv"])
    rows = []
    for p in profiles:
        start, end, tb, tv = ROLE_TARGETS[p["role"]]
        hour = p.get("hour")
        shift = CROWD_SHIFT.get(p.get("crowd"), 0.0)
        shift += 0.04 if hour is not None and hour < 4 else -0.05 if hour is not None and hour <= 8 else -0.02 if hour is not None and 14 <= hour < 18 else 0.0
        line = clip(F.lit(start) + (end - start) * c("ramp") + shift)
        tb = min(max(tb + VENUE_SHIFT.get(p.get("venue"), 0.0), 0.0), 1.0)
        fit = clip(0.65 * (1 - F.abs(c("e") - line)) + 0.20 * (1 - F.abs(c("ba") - tb)) + 0.15 * (1 - F.abs(c("vo") - tv)))
        rows.append(F.struct(F.lit(p["name"]).alias("profile"), fit.alias("fit")))
    means = d.withColumn("z", F.explode(F.array(*rows))).groupBy(by, c("z.profile").alias("profile")).agg(F.avg("z.fit").alias("base"), F.max("__mr").alias("mr"), F.max("__mb").alias("mb"), F.max("__mv").alias("mv"))
    out = means.join(tracks.select(by, "style"), by, "left")
    style = F.lower(F.trim("style"))
    best = F.lit(0.5)
    for p in profiles:
        styles = [s.lower() for s in p.get("styles", ())]
        if styles:
            part = F.lit(False)
            for s in styles:
                part = part | style.contains(s) | F.lit(s).contains(style)
            words = sorted({w for s in styles for w in __import__("re").split(r"[\s/_-]+", s) if w})
            shared = F.arrays_overlap(F.split(style, r"[\s/_-]+"), F.array(*map(F.lit, words)))
            value = F.when(style.isNull() | (style == ""), 0.5).when(style.isin(*styles), 1.0).when(part, 0.8).when(shared, 0.65).otherwise(0.35)
            best = F.when(c("profile") == p["name"], value).otherwise(best)
    parts = sum((c(f"m{x}").isNotNull().cast("int") for x in "rbv"), F.lit(0)) / 3.0
    out = out.withColumn("style_fit", best).withColumn("value", clip(0.85 * c("base") + 0.15 * c("style_fit")))
    return out.select(by, "profile", "base", "style_fit", "value", clip(0.30 + 0.45 * parts + 0.15).alias("confidence"))
