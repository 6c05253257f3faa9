"""Queries on neighbouring tracks and on tempo, key and pair scores."""

from pyspark.sql import functions as F

from seguelake.bindings import MIXES, PAIRS, SLOTS, TRACKS, Tables, sql_fold, sql_relation, sql_step
from seguelake.functions import harmony, hashes, scoring, tempo
from seguelake.functions.numeric import clip, rounded
from seguelake.operators import pairs as op
from seguelake.queries import query

c = F.col
FEATURES = ["bpm", "key", "key_conf", "energy", "bass", "vocal", "style"]
PF = f"""WITH {SLOTS}, {TRACKS}, {PAIRS}, pf AS (SELECT p.mix, p.position, p.a, p.b, x.bpm bpm_a, y.bpm bpm_b, x.num na, x.mode ma,
 y.num nb, y.mode mb, x.camelot ca, y.camelot cb, x.key_conf conf_a, y.key_conf conf_b, x.energy ea, y.energy eb, x.bass ba, y.bass bb,
 x.vocal va, y.vocal vb, x.style sa, y.style sb FROM pairs p JOIN tracks x ON x.track = p.a JOIN tracks y ON y.track = p.b)"""


def slot_pairs(t: Tables):
    return op.adjacency_pairs(t.slots(), "mix", "position", "track", t.slot_bins)


def pair_features(t: Tables):
    return op.with_track_features(slot_pairs(t), t.tracks, FEATURES)


@query("adjacency_pairs", f"WITH {SLOTS}, {PAIRS} SELECT mix, position, a, b FROM pairs")
def _(t):
    return slot_pairs(t)


@query(
    "adjacency_audit",
    f"""WITH {SLOTS} SELECT CASE WHEN track = b THEN 'same_item' ELSE 'pair' END AS kind, count(*) AS n FROM
 (SELECT track, lead(track) OVER (PARTITION BY mix ORDER BY position) AS b FROM slots) WHERE b IS NOT NULL GROUP BY 1""",
)
def _(t):
    return op.adjacency_audit(t.slots(), "mix", "position", "track", t.slot_bins)


FOLD = sql_fold("bpm_a", "bpm_b")
LABEL = """(CASE WHEN abs(bpm_a-bpm_b) <= abs(bpm_a-2*bpm_b) AND abs(bpm_a-bpm_b) <= abs(bpm_a-0.5*bpm_b) THEN 'direct'
 WHEN abs(bpm_a-2*bpm_b) <= abs(bpm_a-0.5*bpm_b) THEN 'double_time_of_b' ELSE 'half_time_of_b' END)"""
NEAREST = f"(bpm_b * CASE {LABEL} WHEN 'direct' THEN 1.0 WHEN 'double_time_of_b' THEN 2.0 ELSE 0.5 END)"


@query(
    "octave_bpm",
    f"""{PF} SELECT mix, position, {LABEL} AS relation, {NEAREST} AS nearest, round({FOLD}, 8) AS gap, bpm_a * 2.0 AS doubled,
 CASE WHEN abs(b/a_/0.5-1)<1e-9 THEN '' ELSE '' END || CASE WHEN bpm_b/bpm_a < 0.583333 THEN CASE WHEN abs(bpm_b/bpm_a-0.5)/0.5<=0.03 THEN '1:2' ELSE 'other' END
 WHEN bpm_b/bpm_a < 0.708333 THEN CASE WHEN abs(bpm_b/bpm_a-2.0/3)/(2.0/3)<=0.03 THEN '2:3' ELSE 'other' END
 WHEN bpm_b/bpm_a < 0.875 THEN CASE WHEN abs(bpm_b/bpm_a-0.75)/0.75<=0.03 THEN '3:4' ELSE 'other' END
 WHEN bpm_b/bpm_a < 1.166667 THEN CASE WHEN abs(bpm_b/bpm_a-1)<=0.03 THEN '1:1' ELSE 'other' END
 WHEN bpm_b/bpm_a < 1.416667 THEN CASE WHEN abs(bpm_b/bpm_a-4.0/3)/(4.0/3)<=0.03 THEN '4:3' ELSE 'other' END
 WHEN bpm_b/bpm_a < 1.75 THEN CASE WHEN abs(bpm_b/bpm_a-1.5)/1.5<=0.03 THEN '3:2' ELSE 'other' END
 ELSE CASE WHEN abs(bpm_b/bpm_a-2)/2<=0.03 THEN '2:1' ELSE 'other' END END AS metric,
 bpm_a * 2.0 / power(2.0, floor(log2(bpm_a * 2.0 / 90.0))) AS folded FROM (SELECT *, a AS a_ FROM pf)""".replace(
        "CASE WHEN abs(b/a_/0.5-1)<1e-9 THEN '' ELSE '' END || ", ""
    ),
)
def _(t):
    a, b = c("bpm_a"), c("bpm_b")
    return pair_features(t).select(
        "mix",
        "position",
        tempo.relation(a, b).alias("relation"),
        tempo.nearest_variant(a, b).alias("nearest"),
        rounded(tempo.relative_distance(a, b), 8).alias("gap"),
        tempo.variants(a)[1].alias("doubled"),
        tempo.metric_relation(a, b).alias("metric"),
        tempo.fold(a * 2).alias("folded"),
    )


@query(
    "tempo_score",
    f"""{PF} SELECT mix, position, round(least(greatest(1 - {FOLD}/0.12, 0), 1), 8) + 0.0 AS proximity,
 round(least(greatest(1 - {FOLD}/0.12, 0), 1) * CASE WHEN {LABEL} = 'direct' THEN 1.0 ELSE 0.1 END, 8) + 0.0 AS succession,
 round(least(greatest(1 - {FOLD}/0.16, 0), 1), 8) + 0.0 AS blend FROM pf""",
)
def _(t):
    a, b = c("bpm_a"), c("bpm_b")
    return pair_features(t).select(
        "mix",
        "position",
        rounded(tempo.proximity(a, b), 8).alias("proximity"),
        rounded(tempo.succession_score(a, b), 8).alias("succession"),
        rounded(tempo.blend_fit(a, b), 8).alias("blend"),
    )


@query("bpm_delta_bucket", f"{PF} SELECT {sql_step('bpm_a', 'bpm_b')} AS bucket, count(*) AS n FROM pf GROUP BY 1")
def _(t):
    return (
        pair_features(t)
        .groupBy(tempo.step_bucket(c("bpm_a"), c("bpm_b")).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


RELATION = sql_relation("na", "ma", "nb", "mb")


@query(
    "camelot",
    f"{PF} SELECT mix, position, na AS number, ma AS mode, CAST(least(abs(na-nb), 12-abs(na-nb)) AS INTEGER) AS distance, {RELATION} AS relation FROM pf",
)
def _(t):
    a, b = c("key_a"), c("key_b")
    return pair_features(t).select(
        "mix",
        "position",
        harmony.number(a).alias("number"),
        harmony.mode(a).alias("mode"),
        harmony.distance(a, b).alias("distance"),
        harmony.relation(a, b).alias("relation"),
    )


CONF = "least(conf_a, conf_b)"
TRUSTED = f"(CASE WHEN {CONF} < 0.15 THEN 'unknown' ELSE {RELATION} END)"
SCORE = f"(CASE {TRUSTED} WHEN 'exact' THEN 1.0 WHEN 'relative_major_minor' THEN 0.85 WHEN 'adjacent_same_mode' THEN 0.85 WHEN 'cautious' THEN 0.6 WHEN 'risky' THEN 0.15 ELSE 0.5 END)::DOUBLE"
RISK = f"(CASE {TRUSTED} WHEN 'exact' THEN 0.05 WHEN 'relative_major_minor' THEN 0.15 WHEN 'adjacent_same_mode' THEN 0.15 WHEN 'cautious' THEN 0.4 WHEN 'risky' THEN 0.8 ELSE 0.5 END)::DOUBLE"
HSCORE = f"round({SCORE} * {CONF} + 0.5 * (1.0 - {CONF}), 4)"
HRISK = f"round(least(greatest({RISK} * (0.5 + (va + vb) / 2) + 0.2 * (1.0 - {CONF}), 0), 1), 4)"


@query(
    "harmonic_compatibility",
    f"""{PF} SELECT mix, position, {TRUSTED} AS relation, {HSCORE} AS score, {HRISK} AS risk,
 CASE WHEN {TRUSTED} = 'risky' AND (va+vb)/2 > 0.4 THEN 'exposed_key_clash' WHEN {TRUSTED} = 'risky' THEN 'masked_key_clash'
 WHEN {CONF} < 0.3 THEN 'verify_key' ELSE '' END AS warning FROM pf""",
)
def _(t):
    args = [c("key_a"), c("key_b"), c("key_conf_a"), c("key_conf_b")]
    shown = (c("vocal_a") + c("vocal_b")) / 2
    return pair_features(t).select(
        "mix",
        "position",
        harmony.trusted_relation(args[0], args[1], harmony.least_confidence(args[2], args[3])).alias("relation"),
        harmony.compatibility(*args).alias("score"),
        harmony.risk(*args, shown).alias("risk"),
        harmony.warning(*args, shown).alias("warning"),
    )


def components(d):
    """Component columns of a pair, from per-track means."""
    args = [c("key_a"), c("key_b"), c("key_conf_a"), c("key_conf_b")]
    shown = (c("vocal_a") + c("vocal_b")) / 2
    return (
        d.withColumn("s_tempo", tempo.blend_fit(c("bpm_a"), c("bpm_b")))
        .withColumn("s_energy", scoring.energy_fit(c("energy_a"), c("energy_b")))
        .withColumn("r_bass", scoring.shared_exposure(c("bass_a"), c("bass_b")))
        .withColumn("r_vocal", scoring.shared_exposure(c("vocal_a"), c("vocal_b")))
        .withColumn("s_style", scoring.style_fit(c("style_a"), c("style_b")))
        .withColumn("s_harmonic", harmony.compatibility(*args))
        .withColumn("r_harmonic", harmony.risk(*args, shown))
        .withColumn("s_tension", scoring.tension_fit(c("energy_a"), c("bass_b")))
    )


COMP = f"""{PF}, comp AS (SELECT *, least(greatest(1 - {FOLD}/0.16, 0), 1) AS s_tempo, 1.0 - abs(ea-eb)/greatest(ea,eb,1e-9) AS s_energy,
 least(ba,bb) AS r_bass, least(va,vb) AS r_vocal, CASE WHEN sa = sb THEN 1.0 ELSE 0.5 END::DOUBLE AS s_style, {HSCORE} AS s_harmonic,
 {HRISK} AS r_harmonic, 1.0 - abs(ea-bb) AS s_tension, {LABEL} AS rel, round({FOLD}*100, 2) AS gap FROM pf)"""


@query(
    "pair_component_scores",
    f"""{COMP} SELECT mix, position, round(s_energy, 8) + 0.0 AS energy, r_bass AS bass_conflict, r_vocal AS vocal_conflict, s_style AS style,
 round(s_tension, 8) + 0.0 AS tension FROM comp""",
)
def _(t):
    return components(pair_features(t)).select(
        "mix",
        "position",
        rounded(c("s_energy"), 8).alias("energy"),
        c("r_bass").alias("bass_conflict"),
        c("r_vocal").alias("vocal_conflict"),
        c("s_style").alias("style"),
        rounded(c("s_tension"), 8).alias("tension"),
    )


def parts_of():
    return {
        "tempo": c("s_tempo"),
        "energy": c("s_energy"),
        "bass": 1.0 - c("r_bass"),
        "style": c("s_style"),
        "vocal": 1.0 - c("r_vocal"),
        "harmonic": c("s_harmonic"),
        "tension": c("s_tension"),
    }


def scored_pairs(t):
    """Pairs with mixability, confidence and rules."""
    d = components(pair_features(t))
    d = d.withColumn("gap", tempo.effective_step_pct(c("bpm_a"), c("bpm_b"))).withColumn("rel", tempo.relation(c("bpm_a"), c("bpm_b")))
    return d.withColumn("mixability", scoring.mixability(parts_of())).withColumn(
        "rules", scoring.pair_rules(c("gap"), c("rel"), c("r_harmonic"), c("r_vocal"), c("r_bass"), None, c("s_tension"))
    )


MIX = """(0.17*s_tempo + 0.13*0.5 + 0.13*s_energy + 0.13*(1-r_bass) + 0.08*(1-r_vocal) + 0.08*s_tension + 0.08*s_style + 0.05*0.5 + 0.15*s_harmonic)"""


@query(
    "mixability",
    f"""{COMP} SELECT mix, position, round({MIX}, 8) AS score, round(7/9.0::DOUBLE*0.8, 2) AS confidence, 'context,phrase' AS missing FROM comp""",
)
def _(t):
    return scored_pairs(t).select(
        "mix",
        "position",
        rounded(c("mixability"), 8).alias("score"),
        scoring.coverage_confidence(parts_of()).alias("confidence"),
        F.array_join(scoring.missing_components(parts_of()), ",").alias("missing"),
    )


RULES = f"""{COMP}, ruled AS (SELECT *, {MIX} AS mixability,
 CASE WHEN rel <> 'direct' AND gap <= 2.5 THEN 'octave_handling' WHEN gap <= 6 THEN '' WHEN gap <= 10 THEN 'tempo_gap' WHEN gap <= 18 THEN 'tempo_jump' ELSE 'tempo_extreme' END AS tc,
 CASE WHEN r_harmonic >= 0.75 THEN 'harmonic_fail' WHEN r_harmonic >= 0.5 THEN 'harmonic_review' ELSE '' END AS hc,
 CASE WHEN r_vocal >= 0.70 THEN 'vocal_fail' WHEN r_vocal >= 0.5 THEN 'vocal_review' ELSE '' END AS vc,
 CASE WHEN r_bass >= 0.72 THEN 'bass_fail' WHEN r_bass >= 0.55 THEN 'bass_review' ELSE '' END AS bc,
 CASE WHEN s_tension < 0.35 THEN 'tension_fail' WHEN s_tension < 0.45 THEN 'tension_review' ELSE '' END AS nc FROM comp),
 gated AS (SELECT *, tc = 'tempo_extreme' OR hc = 'harmonic_fail' OR vc = 'vocal_fail' OR bc = 'bass_fail' AS hard_block,
 CASE tc WHEN '' THEN 'pass' WHEN 'tempo_extreme' THEN 'fail' ELSE 'strategy_dependent' END AS tempo_gate,
 CASE hc WHEN '' THEN 'pass' WHEN 'harmonic_fail' THEN 'fail' ELSE 'review' END AS harmonic_gate,
 round(least(0.45, (CASE tc WHEN 'octave_handling' THEN 0.08 WHEN '' THEN 0.0 WHEN 'tempo_gap' THEN 0.10 WHEN 'tempo_jump' THEN 0.14 ELSE 0.18 END
 + CASE hc WHEN '' THEN 0 WHEN 'harmonic_fail' THEN 0.16 ELSE 0.08 END + CASE vc WHEN '' THEN 0 WHEN 'vocal_fail' THEN 0.14 ELSE 0.06 END
 + CASE bc WHEN '' THEN 0 WHEN 'bass_fail' THEN 0.14 ELSE 0.06 END + CASE nc WHEN '' THEN 0 WHEN 'tension_fail' THEN 0.08 ELSE 0.04 END))::DOUBLE, 4) AS penalty,
 array_to_string(list_filter([tc, hc, vc, bc, nc], lambda x: x <> ''), ',') AS flags FROM ruled),
 risked AS (SELECT *, tc = '' AND NOT hard_block AS standard_allowed, flags <> '' AS review,
 (r_harmonic + r_vocal + r_bass + (1 - s_tension) + least(penalty*2, 1) + CASE WHEN hard_block THEN 1 ELSE 0 END) / CASE WHEN hard_block THEN 6 ELSE 5 END AS risk FROM gated)"""


@query("pair_rules", f"{RULES} SELECT mix, position, tempo_gate, harmonic_gate, standard_allowed, hard_block, review, penalty, flags FROM risked")
def _(t):
    r = c("rules")
    return scored_pairs(t).select(
        "mix",
        "position",
        *[r[n].alias(n) for n in ("tempo_gate", "harmonic_gate", "standard_allowed", "hard_block", "review", "penalty")],
        F.array_join(r["flags"], ",").alias("flags"),
    )


def with_risk(t):
    d = scored_pairs(t).withColumn(
        "risk",
        scoring.pair_risk(c("rules"), c("r_harmonic"), c("r_vocal"), c("r_bass"), F.lit(None).cast("double"), c("s_tension")),
    )
    return d.withColumn("confidence", scoring.coverage_confidence(parts_of()))


POLICY = """CASE WHEN hard_block THEN 'suppress' WHEN risk >= 0.82 AND 0.62 < 0.58 THEN 'suppress'
 WHEN review OR risk >= 0.58 THEN 'review_only' ELSE 'allow' END"""


@query("recommendation_policy", f"{RULES} SELECT mix, position, round(risk, 8) + 0.0 AS risk, {POLICY} AS policy FROM risked")
def _(t):
    r = c("rules")
    chosen = scoring.policy(c("confidence"), c("risk"), r["hard_block"], r["review"], F.lit(False), c("mixability"))
    return with_risk(t).select("mix", "position", rounded(c("risk"), 8).alias("risk"), chosen.alias("policy"))


STRATEGY = f"""{RULES}, first AS (SELECT *, (r_vocal + s_energy)/2 AS wrisk, position % 3 = 0 AS bridging FROM risked),
 strat AS (SELECT *, CASE WHEN rel <> 'direct' AND gap <= 2.5 THEN 'half_time_double_time_switch' WHEN gap <= 2 THEN 'standard_blend'
 WHEN gap <= 4 THEN 'short_blend' WHEN gap <= 6 AND rel = 'direct' AND wrisk < 0.45 THEN 'phrase_aligned_blend' WHEN gap <= 10 THEN 'tempo_ramp'
 WHEN gap <= 18 AND bridging THEN 'break_transition' WHEN gap <= 18 THEN 'echo_out' WHEN bridging THEN 'reset' ELSE 'hard_cut' END AS s0,
 standard_allowed AND NOT (rel <> 'direct' AND gap <= 2.5) AND (gap <= 4 OR (gap <= 6 AND rel = 'direct' AND wrisk < 0.45)) AS allowed FROM first),
 strategies AS (SELECT *, CASE WHEN NOT standard_allowed AND s0 IN ('standard_blend','short_blend','phrase_aligned_blend') THEN
 CASE WHEN gap <= 10 THEN 'echo_out' ELSE 'hard_cut' END ELSE s0 END AS strategy FROM strat)"""


def strategised(t):
    chosen = scoring.strategy(c("rules"), (c("r_vocal") + c("s_energy")) / 2, c("position") % 3 == 0)
    return with_risk(t).withColumn("window_risk", (c("r_vocal") + c("s_energy")) / 2).withColumn("s", chosen)


@query(
    "transition_strategy",
    f"""{STRATEGY} SELECT mix, position, strategy, CASE WHEN rel <> 'direct' AND gap <= 2.5 THEN 'medium' WHEN gap <= 4 THEN 'high'
 WHEN gap <= 10 THEN 'medium' ELSE 'low' END AS feasibility, allowed AS standard_allowed FROM strategies""",
)
def _(t):
    s = c("s")
    return strategised(t).select("mix", "position", *[s[n].alias(n) for n in ("strategy", "feasibility", "standard_allowed")])


@query(
    "blend_profile",
    f"""{STRATEGY} SELECT CASE WHEN strategy NOT IN ('standard_blend','short_blend','phrase_aligned_blend') THEN 'plain_blend'
 WHEN r_bass >= 0.45 THEN 'bass_swap' WHEN r_vocal >= 0.22 THEN 'contour_blend' WHEN strategy <> 'standard_blend' THEN 'tops_swap'
 ELSE 'plain_blend' END AS profile, strategy, count(*) AS n FROM strategies GROUP BY ALL""",
)
def _(t):
    profile = scoring.blend_profile(c("s.strategy"), c("r_bass"), c("r_vocal"))
    return strategised(t).groupBy(profile.alias("profile"), c("s.strategy").alias("strategy")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "decision_class",
    f"""{STRATEGY}, severed AS (SELECT *, r_harmonic >= 0.72 OR r_vocal >= 0.72 OR r_bass >= 0.72 AS severe FROM strategies)
 SELECT mix, position, CASE WHEN hard_block THEN 'reject_standard_blend' WHEN mixability >= 0.72 AND allowed AND tempo_gate = 'pass'
 AND harmonic_gate = 'pass' AND wrisk < 0.45 AND eb >= 0.55 AND NOT severe THEN 'strong_candidate'
 WHEN mixability < 0.45 OR (tempo_gate = 'fail' AND severe) THEN 'reject_standard_blend'
 WHEN NOT allowed AND mixability >= 0.55 THEN 'non_standard_strategy_required' ELSE 'review_required' END AS decision FROM severed""",
)
def _(t):
    d = scoring.decision_class(
        c("mixability"), c("confidence"), c("rules"), c("s.standard_allowed"), c("energy_b"), c("window_risk"),
        c("r_harmonic"), c("r_vocal"), c("r_bass"),
    )
    return strategised(t).select("mix", "position", d.alias("decision"))


@query(
    "transition_score",
    f"""{COMP} SELECT mix, position, mode AS planner, round(CASE mode WHEN 'smart' THEN 0.35*s_harmonic + 0.25*tb + 0.2*te + 0.2*{MIX}
 WHEN 'harmonic' THEN 0.55*s_harmonic + 0.15*tb + 0.1*te + 0.2*{MIX} ELSE 0.15*s_harmonic + 0.55*tb + 0.1*te + 0.2*{MIX} END, 8) + 0.0 AS score FROM
 (SELECT * REPLACE (CASE mix % 3 WHEN 0 THEN 'smart' WHEN 1 THEN 'harmonic' ELSE 'bpm' END AS mode),
 least(greatest(1 - {FOLD}/0.12, 0), 1) * CASE WHEN rel = 'direct' THEN 1.0 ELSE 0.1 END AS tb,
 CASE mix % 4 WHEN 0 THEN 1.0 WHEN 1 THEN CASE WHEN eb-ea >= -0.02 THEN least(greatest(0.6+4*(eb-ea),0),1) ELSE least(greatest(0.6+8*(eb-ea),0),1) END
 WHEN 2 THEN least(greatest(1-6*abs(eb-ea),0),1) ELSE least(greatest(1-5*abs(eb-ea),0),1) END AS te FROM (SELECT *, '' AS mode FROM comp))""",
)
def _(t):
    mode = F.when(c("mix") % 3 == 0, "smart").when(c("mix") % 3 == 1, "harmonic").otherwise("bpm")
    arc = F.when(c("mix") % 4 == 0, "off").when(c("mix") % 4 == 1, "build").when(c("mix") % 4 == 2, "peak").otherwise("flat")
    score = scoring.planner_score(
        c("planner"),
        c("s_harmonic"),
        tempo.succession_score(c("bpm_a"), c("bpm_b")),
        scoring.arc_energy(c("energy_b") - c("energy_a"), arc),
        c("mixability"),
    )
    return scored_pairs(t).withColumn("planner", mode).select("mix", "position", "planner", rounded(score, 8).alias("score"))


@query(
    "tempo_adjustment",
    f"""{PF}, o AS (SELECT *, {LABEL} AS rel FROM pf), n AS (SELECT mix, position, bpm_a,
 bpm_b * CASE rel WHEN 'direct' THEN 1.0 WHEN 'double_time_of_b' THEN 2.0 ELSE 0.5 END AS sel,
 CAST(CASE rel WHEN 'direct' THEN 0 WHEN 'double_time_of_b' THEN 1 ELSE -1 END AS INTEGER) AS octave FROM o),
 m AS (SELECT *, least(bpm_a, sel) AS lo, greatest(bpm_a, sel) AS hi FROM n),
 q AS (SELECT *, CASE WHEN abs(hi-lo) <= 1e-12 THEN lo ELSE least(hi, greatest(lo, ((0.765-1.0)*lo + sqrt((0.765-1.0)*(0.765-1.0)*lo*lo + 4*0.765*hi*lo))/(2*0.765))) END AS target FROM m)
 SELECT mix, position, octave, sel AS selected, round(target, 6) AS target,
 round(CASE WHEN target/bpm_a > 1 THEN 0.765*(target/bpm_a-1) WHEN target/bpm_a < 1 THEN bpm_a/target-1 ELSE 0 END, 6) + 0.0 AS strain_a,
 round(CASE WHEN target/sel > 1 THEN 0.765*(target/sel-1) WHEN target/sel < 1 THEN sel/target-1 ELSE 0 END, 6) + 0.0 AS strain_b,
 greatest(abs(target/bpm_a-1), abs(target/sel-1)) <= 0.1 AS within_band FROM q""",
)
def _(t):
    d = (
        pair_features(t)
        .withColumn("o", tempo.nearest_octave(c("bpm_a"), c("bpm_b")))
        .withColumn("target", tempo.meeting_tempo(c("bpm_a"), c("o.bpm")))
        .withColumn("ra", c("target") / c("bpm_a"))
        .withColumn("rb", c("target") / c("o.bpm"))
    )
    return d.select(
        "mix",
        "position",
        c("o.octave").alias("octave"),
        c("o.bpm").alias("selected"),
        rounded(c("target")).alias("target"),
        rounded(tempo.strain(c("ra"))).alias("strain_a"),
        rounded(tempo.strain(c("rb"))).alias("strain_b"),
        (F.greatest(F.abs(c("ra") - 1), F.abs(c("rb") - 1)) <= 0.1 + 1e-12).alias("within_band"),
    )


@query(
    "transition_deltas",
    f"""WITH {SLOTS}, {TRACKS}, s AS (SELECT mix, position, bpm, energy FROM slots JOIN tracks USING (track)),
 d AS (SELECT mix, position, bpm - lag(bpm) OVER w AS bs, energy - lag(energy) OVER w AS es, lag(bpm) OVER w AS pb, bpm FROM s WINDOW w AS (PARTITION BY mix ORDER BY position))
 SELECT mix, position, bs AS bpm_step, round((bpm-pb)/pb*100, 6) + 0.0 AS bpm_pct, round(es, 6) + 0.0 AS energy_step FROM d""",
)
def _(t):
    s = t.slots().join(t.tracks.select("track", "bpm", "energy"), "track")
    d = op.transition_deltas(s, "mix", "position", ["bpm", "energy"], t.slot_bins)
    return d.select(
        "mix", "position", "bpm_step", rounded(c("bpm_pct")).alias("bpm_pct"), rounded(c("energy_step")).alias("energy_step")
    )


HEX = "('0x' || substr(sha256({0}), {1}, 8))::BIGINT"
CHANCE = f"""drawn AS (SELECT p.mix, p.position, n, {HEX.format("'11|' || p.mix || '|' || p.position", 1)} % n + 1 AS p1,
 {HEX.format("'11|' || p.mix || '|' || p.position", 9)} AS h2 FROM pairs p JOIN (SELECT mix, max(position) AS n FROM slots GROUP BY mix) USING (mix) WHERE n >= 2),
 chance AS (SELECT d.mix, d.position, x.track AS a, y.track AS b FROM drawn d JOIN slots x ON x.mix = d.mix AND x.position = d.p1
 JOIN slots y ON y.mix = d.mix AND y.position = (d.p1 + d.h2 % (d.n - 1)) % d.n + 1)"""


def chance(t):
    return op.chance_pairs(t.slots(), slot_pairs(t), "mix", "position", "track", 11)


@query("chance_pairs", f"WITH {SLOTS}, {PAIRS}, {CHANCE} SELECT mix, position, a, b FROM chance")
def _(t):
    return chance(t)


DIST = f"""WITH {SLOTS}, {TRACKS}, {PAIRS}, {CHANCE}, allp AS (SELECT 'real' AS src, a, b FROM pairs UNION ALL SELECT 'chance', a, b FROM chance),
 feat AS (SELECT src, {sql_step('x.bpm', 'y.bpm')} AS tempo, {sql_relation('x.num', 'x.mode', 'y.num', 'y.mode')} AS harmonic
 FROM allp JOIN tracks x ON x.track = a JOIN tracks y ON y.track = b),
 long AS (SELECT src, 'tempo' AS kind, tempo AS bucket FROM feat UNION ALL SELECT src, 'harmonic', harmonic FROM feat),
 dist AS (SELECT src, kind, bucket, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY src, kind) * 100, 1) AS pct FROM long GROUP BY src, kind, bucket),
 lifts AS (SELECT kind, bucket, r.pct AS real_pct, k.pct AS chance_pct,
 least(greatest(coalesce(r.pct, 0.1)/greatest(coalesce(k.pct, 0.1), 0.1), 0.4), 2.0) AS lift
 FROM (SELECT * FROM dist WHERE src = 'real') r FULL JOIN (SELECT * FROM dist WHERE src = 'chance') k USING (kind, bucket))"""


def bucketed(t, pairs):
    d = op.with_track_features(pairs, t.tracks, ["bpm", "key"])
    return d.withColumn("tempo", tempo.step_bucket(c("bpm_a"), c("bpm_b"))).withColumn(
        "harmonic", harmony.relation(c("key_a"), c("key_b"))
    )


KINDS = ["tempo", "harmonic"]


def all_lifts(t):
    return op.preference_lift(op.bucket_distribution(bucketed(t, slot_pairs(t)), KINDS), op.bucket_distribution(bucketed(t, chance(t)), KINDS))


@query("bucket_distribution", f"{DIST} SELECT kind, bucket, n, pct FROM dist WHERE src = 'real'")
def _(t):
    return op.bucket_distribution(bucketed(t, slot_pairs(t)), KINDS)


@query("preference_lift", f"{DIST} SELECT kind, bucket, real_pct, chance_pct, round(lift, 6) AS lift FROM lifts")
def preference_lift(t):
    return all_lifts(t).withColumn("lift", rounded(c("lift")))


@query(
    "prior_lift",
    f"""{DIST}, own AS (SELECT mix, position, {sql_step('x.bpm', 'y.bpm')} AS tempo, {sql_relation('x.num', 'x.mode', 'y.num', 'y.mode')} AS harmonic
 FROM pairs JOIN tracks x ON x.track = a JOIN tracks y ON y.track = b) SELECT mix, position, round(least(greatest(coalesce(l.lift, 1) * coalesce(m.lift, 1), 0.4), 2.0), 6) AS lift
 FROM own LEFT JOIN lifts l ON l.kind = 'tempo' AND l.bucket = tempo LEFT JOIN lifts m ON m.kind = 'harmonic' AND m.bucket = harmonic""",
)
def _(t):
    d = op.prior_lift(bucketed(t, slot_pairs(t)), all_lifts(t), ["tempo", "harmonic"])
    return d.select("mix", "position", rounded(c("lift")).alias("lift"))


@query(
    "candidate_pairs",
    f"""WITH {SLOTS}, {TRACKS}, req AS (SELECT mix AS req, track, bpm, style FROM slots JOIN tracks USING (track) WHERE position = 1)
 SELECT req, r.track AS a, p.track AS b, r.bpm AS bpm_a, p.bpm AS bpm_b FROM req r JOIN tracks p ON p.style = r.style AND p.track <> r.track
 AND {sql_fold('r.bpm', 'p.bpm')} <= 0.06 AND NOT EXISTS (SELECT 1 FROM slots s WHERE s.mix = r.req AND s.track = p.track)""",
)
def _(t):
    tracks = t.tracks.select("track", "style", "bpm")
    slots = t.slots()
    requests = slots.filter(c("position") == 1).join(tracks, "track").withColumnRenamed("mix", "req")
    return op.candidate_pairs(requests, tracks, slots.select(c("mix").alias("req"), "track"))


@query(
    "circular_key_features",
    f"""WITH {TRACKS} SELECT track, round(sin(2*pi()*(num-1)/12), 8) + 0.0 AS sine, round(cos(2*pi()*(num-1)/12), 8) + 0.0 AS cosine,
 CASE mode WHEN 'B' THEN 1.0 ELSE 0.0 END::DOUBLE AS major, key_conf AS confidence, 0.0::DOUBLE AS missing FROM tracks""",
)
def _(t):
    v = harmony.angle_features(c("key"), c("key_conf"))
    return t.tracks.select(
        "track", rounded(v[0], 8).alias("sine"), rounded(v[1], 8).alias("cosine"), v[2].alias("major"), v[3].alias("confidence"), v[4].alias("missing")
    )


@query(
    "key_distance_fifths",
    f"""{PF} SELECT mix, position, least(((((na-nb)*7) % 12) + 12) % 12, 12 - ((((na-nb)*7) % 12) + 12) % 12)::DOUBLE AS steps FROM pf""",
)
def _(t):
    steps = harmony.fifths_distance(harmony.number(c("key_a")), harmony.number(c("key_b")))
    return pair_features(t).select("mix", "position", steps.alias("steps"))


@query(
    "stable_hashes",
    f"""WITH {SLOTS}, {PAIRS} SELECT mix, position, sha1(a || '->' || b) AS edge, sha256('7|' || mix) AS split_hash,
 sha256('{{"mix":' || mix || ',"a":' || a || ',"b":' || b || '}}') AS content FROM pairs""",
)
def _(t):
    return slot_pairs(t).select(
        "mix",
        "position",
        hashes.edge(c("a"), c("b")).alias("edge"),
        hashes.seeded(7, c("mix")).alias("split_hash"),
        hashes.content(c("mix"), c("a"), c("b")).alias("content"),
    )


EDGE_HISTORY = f"""WITH {SLOTS}, {PAIRS}, edges AS (SELECT a, b, count(*) AS n FROM pairs GROUP BY a, b),
 seen AS (SELECT track, count(DISTINCT mix) AS n FROM slots GROUP BY track)"""


@query(
    "novelty_penalty",
    f"""{EDGE_HISTORY} SELECT mix, position, round(CASE WHEN e.n > 1 THEN 0.12 ELSE 0 END + CASE WHEN p.b % 5 <> 0 AND s.n > 1 THEN 0.08 ELSE 0 END, 6)::DOUBLE AS penalty
 FROM pairs p JOIN edges e USING (a, b) JOIN seen s ON s.track = p.b""",
)
def _(t):
    pairs = slot_pairs(t)
    edges = pairs.groupBy("a", "b").agg((F.count(F.lit(1)) > 1).alias("edge_seen"))
    seen = t.plays.groupBy(c("track").alias("b")).agg(F.count_distinct("mix").alias("n"))
    d = pairs.join(edges, ["a", "b"], "left").join(seen, "b", "left")
    cost = scoring.novelty_penalty(c("edge_seen"), c("n"), c("b") % 5 == 0, "fresh")
    return d.select("mix", "position", rounded(cost).alias("penalty"))
