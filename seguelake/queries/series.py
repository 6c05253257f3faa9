"""Queries on per-track series, runs and plans."""

from pyspark.sql import functions as F

from seguelake.bindings import FRAMES, MIXES, PAIRS, SLOTS, TRACKS
from seguelake.functions.numeric import rounded
from seguelake.operators import histories, joins, table_functions
from seguelake.operators import series as op
from seguelake.operators.filters import qualify_reason
from seguelake.queries import query
from seguelake.session import cut_lineage
from seguelake.queries.evaluation import r6
from seguelake.queries.filters import with_alignment
from seguelake.queries.joins import windows_of, WINDOWS
from seguelake.queries.pairs import slot_pairs

c = F.col
W = "WINDOW w AS (PARTITION BY track ORDER BY t)"


def pad(v: str, k: int, fn: str) -> str:
    return "coalesce(" + ", ".join(f"{fn}({v}, {i}) OVER w" for i in range(k, 0, -1)) + f", {v})"


def padded(v: str, r: int) -> str:
    return "[" + ", ".join([pad(v, k, "lag") for k in range(r, 0, -1)] + [v] + [pad(v, k, "lead") for k in range(1, r + 1)]) + "]"


def grad(v: str) -> str:
    return f"CASE WHEN lag({v}) OVER w IS NULL THEN coalesce(lead({v}) OVER w - {v}, 0) WHEN lead({v}) OVER w IS NULL THEN {v} - lag({v}) OVER w ELSE (lead({v}) OVER w - lag({v}) OVER w)/2.0::DOUBLE END"


def grad_t(v: str) -> str:
    hs, hd = "(t - lag(t) OVER w)", "(lead(t) OVER w - t)"
    return f"""CASE WHEN lag({v}) OVER w IS NULL THEN coalesce((lead({v}) OVER w - {v})/{hd}, 0) WHEN lead({v}) OVER w IS NULL THEN ({v} - lag({v}) OVER w)/{hs}
 ELSE ({hs}*{hs}*lead({v}) OVER w + ({hd}*{hd} - {hs}*{hs})*{v} - {hd}*{hd}*lag({v}) OVER w)/({hs}*{hd}*({hd}+{hs})) END"""


@query(
    "rolling_std_mean",
    f"""WITH {FRAMES}, p AS (SELECT event_id, {padded("value", 2)} AS a, {padded("value", 4)} AS b FROM frames {W})
 SELECT event_id, round(list_stddev_pop(a), 6) + 0.0 AS std5, round(list_sum(b)/9, 6) AS mean9 FROM p""",
)
def _(t):
    d = op.rolling(t.frames, "track", "t", t.frame_bins, "value", 2, std="std5")
    d = op.rolling(d, "track", "t", t.frame_bins, "value", 4, mean="mean9")
    return r6(d, ("std5", "mean9"), ("event_id",))


@query("gradient", f"WITH {FRAMES} SELECT event_id, round(({grad_t('value')}) * 1000, 6) + 0.0 AS slope, round({grad('value')}, 6) + 0.0 AS unit_slope FROM frames {W}")
def _(t):
    d = op.gradient(t.frames, "track", "t", t.frame_bins, "value", "t", "g")
    d = op.gradient(d, "track", "t", t.frame_bins, "value", None, "unit_slope")
    return d.select("event_id", rounded(c("g") * 1000).alias("slope"), rounded(c("unit_slope")).alias("unit_slope"))


def robust(v: str) -> str:
    lo, hi = f"quantile_cont({v}, 0.05) OVER (PARTITION BY track)", f"quantile_cont({v}, 0.95) OVER (PARTITION BY track)"
    return f"CASE WHEN {hi} - {lo} < 1e-12 THEN 0.5 ELSE least(greatest(({v} - {lo})/({hi} - {lo}), 0), 1) END"


def minmax(v: str) -> str:
    lo, hi = f"min({v}) OVER (PARTITION BY track)", f"max({v}) OVER (PARTITION BY track)"
    return f"CASE WHEN {hi} - {lo} < 1e-12 THEN 0.5 ELSE ({v} - {lo})/({hi} - {lo}) END"


@query("normalize_curve", f"WITH {FRAMES} SELECT event_id, round({minmax('value')}, 6) + 0.0 AS minmax, round({robust('value')}, 6) + 0.0 AS robust FROM frames")
def _(t):
    d = op.normalized(t.frames, "track", "value", "minmax", "minmax")
    return r6(op.normalized(d, "track", "value", "robust", "robust"), ("minmax", "robust"), ("event_id",))


@query("local_maxima", f"WITH {FRAMES} SELECT event_id, coalesce(value > lag(value) OVER w AND value >= lead(value) OVER w, false) AS peak FROM frames {W}")
def _(t):
    return op.local_maxima(t.frames, "track", "t", t.frame_bins, "value", "peak").select("event_id", "peak")


PEAKS = f"""{FRAMES}, pk AS (SELECT track, t, value FROM (SELECT *, value > lag(value) OVER w AND value >= lead(value) OVER w AS peak FROM frames {W}) WHERE peak),
 b1 AS (SELECT track, arg_max(t, (value, -t)) AS x, max(value) AS s FROM pk GROUP BY 1), p2 AS (SELECT pk.* FROM pk JOIN b1 USING (track) WHERE abs(t - x) >= 7200),
 b2 AS (SELECT track, arg_max(t, (value, -t)) AS x, max(value) AS s FROM p2 GROUP BY 1), p3 AS (SELECT p2.* FROM p2 JOIN b2 USING (track) WHERE abs(t - x) >= 7200), b3 AS (SELECT track, arg_max(t, (value, -t)) AS x, max(value) AS s FROM p3 GROUP BY 1),
 sel AS (SELECT track, 1 AS rank, x, s FROM b1 UNION ALL SELECT track, 2, x, s FROM b2 UNION ALL SELECT track, 3, x, s FROM b3), sp AS (SELECT track, min(t) AS ta, max(t) AS tz FROM frames GROUP BY 1),
 win AS (SELECT track, rank, x AS peak, s AS score, greatest(ta, x - 3600) AS start, least(tz, x + 3600) AS "end", tz AS duration FROM sel JOIN sp USING (track))"""


def peak_windows(t):
    peaks = op.local_maxima(t.frames, "track", "t", t.frame_bins, "value", "peak").filter("peak").withColumnRenamed("value", "score")
    return op.spaced_peaks(peaks, t.frames, "track", "t", "score", 3, 7200.0, 3600.0)


@query("topk_nms_windows", f'WITH {PEAKS} SELECT track, rank, score, round(peak, 6) AS peak, round(start, 6) + 0.0 AS start, round("end", 6) AS "end" FROM win')
def _(t):
    return r6(peak_windows(t), ("peak", "start", "end"), ("track", "rank", "score"))


@query("pick_windows", f'WITH {PEAKS} SELECT track, rank, score, round(peak, 6) AS peak, round(start, 6) + 0.0 AS start, round("end", 6) AS "end" FROM win')
def _(t):
    peaks = op.local_maxima(t.frames, "track", "t", t.frame_bins, "value", "peak").filter("peak").withColumnRenamed("value", "score")
    d = table_functions.windows_by_function(peaks, t.frames, "track", "t", "score", 3, 7200.0, 3600.0)
    return r6(d, ("peak", "start", "end"), ("track", "rank", "score"))


@query(
    "window_role",
    f"""WITH {PEAKS}, k AS (SELECT *, CASE WHEN peak/duration < 1.0::DOUBLE/3 THEN 'mix_in' WHEN peak/duration > 2.0::DOUBLE/3 THEN 'mix_out' ELSE 'bridge' END AS kind, greatest(duration - start, 0) * 120 / 60 AS room FROM win),
 f AS (SELECT *, room >= 60000 + CASE kind WHEN 'mix_out' THEN 8 ELSE 0 END AS fits FROM k)
 SELECT track, rank, kind, fits, CAST(row_number() OVER (PARTITION BY track, kind ORDER BY fits DESC, CASE WHEN NOT fits THEN room END DESC NULLS LAST, score DESC, start) AS INTEGER) AS role_rank FROM f""",
)
def _(t):
    d = peak_windows(t).withColumn("bpm", F.lit(120.0)).withColumn("beats", F.lit(60000))
    return op.window_role(d).select("track", "rank", "kind", "fits", "role_rank")


def component_frames(t):
    return t.frames.select(
        "event_id", "track", "us", "t", c("value").alias("rms"), c("k").cast("double").alias("bass"), (c("value") * 2).alias("flux"),
        (c("k") / 100.0).alias("vocal"), (c("value") - c("k")).alias("tension"),
    )


@query(
    "transition_components",
    f"""WITH {FRAMES}, f AS (SELECT event_id, track, t, value AS rms, k::DOUBLE AS bass, value*2 AS flux, k/100.0::DOUBLE AS vocal, value - k AS tension FROM frames), sp AS (SELECT track, min(t) AS ta, max(t) AS tz FROM f GROUP BY 1),
 bd AS (SELECT DISTINCT track, t FROM frames JOIN sp USING (track) WHERE label = 'error' AND t > ta AND t < tz), an AS (SELECT track, t FROM frames WHERE label = 'view'),
 g AS (SELECT *, abs({grad("rms")}) AS g, list_stddev_pop({padded("flux", 2)}) AS sd FROM f {W}),
 n AS (SELECT *, 1 - ({minmax("g")}) AS energy, 1 - ({minmax("sd")}) AS rhythm, 1 - ({robust("bass")}) AS bassf, {robust("tension")} AS tc FROM g),
 d AS (SELECT n.*, least(n.t - b1.t, b2.t - n.t) AS d1, least(n.t - a1.t, a2.t - n.t) AS d2 FROM n ASOF LEFT JOIN bd b1 ON b1.track = n.track AND b1.t <= n.t ASOF LEFT JOIN bd b2 ON b2.track = n.track AND b2.t >= n.t
 ASOF LEFT JOIN an a1 ON a1.track = n.track AND a1.t <= n.t ASOF LEFT JOIN an a2 ON a2.track = n.track AND a2.t >= n.t),
 s AS (SELECT *, coalesce(exp(-d1/28800), 0.5) AS st, coalesce(exp(-d2/14400), 0.5) AS ph FROM d)
 SELECT event_id, round(energy, 6) + 0.0 AS energy, round(rhythm, 6) + 0.0 AS rhythm, round(st, 6) + 0.0 AS structural, round(ph, 6) + 0.0 AS phrase, round(0.25*st + 0.15*rhythm + 0.2*energy + 0.15*ph + 0.25*bassf - 0.5*vocal - 0.3*tc, 6) + 0.0 AS score FROM s""",
)
def _(t):
    marks = lambda label: t.frames.filter(c("label") == label).select("track", "t")
    d = op.transition_components(component_frames(t), marks("error"), marks("view"), "track", t.frame_bins, 28800.0, 14400.0, 3600.0)
    return r6(d, ("energy", "rhythm", "structural", "phrase", "score"), ("event_id",))


CURVES = f"""{FRAMES}, f AS (SELECT event_id, track, t, value AS rms, k::DOUBLE AS flux, (event_id % 10)/10.0::DOUBLE AS onset, value*k AS bass, (event_id % 7)/7.0::DOUBLE AS pulse, (event_id % 5)/5.0::DOUBLE AS vocal,
 (event_id % 3)/3.0::DOUBLE AS sync, (event_id % 4)/8.0::DOUBLE AS micro FROM frames),
 n AS (SELECT *, {robust("rms")} AS rn, {robust("flux")} AS fn, {robust("onset")} AS onn, {robust("bass")} AS bn FROM f),
 g AS (SELECT *, abs({grad("fn")}) AS df, greatest({grad("rn")}, 0) AS rise, greatest({grad("fn")}, 0) AS fr, greatest({grad("onn")}, 0) AS orr, greatest(rn - list_sum({padded("rn", 4)})/9, 0) AS delay FROM n {W}),
 b AS (SELECT *, least(greatest(0.4*bn + 0.3*pulse + 0.2*(1 - ({minmax("df")})) - 0.1*least(greatest(0.6*fn + 0.4*vocal, 0), 1), 0), 1) AS bass_salience,
 least(greatest(0.25*rise + 0.15*delay + 0.25*least(0.6*fn + 0.4*fr, 1) + 0.15*(0.5*(1-pulse) + 0.5*micro) + 0.2*least(0.5*sync + 0.5*orr, 1), 0), 1) AS tension FROM g),
 h AS (SELECT *, least(0.25*pulse + 0.2*sync + 0.2*onset + 0.2*bass_salience + 0.15*least(greatest(1 - abs(micro - 0.25)/0.75, 0), 1), 1) AS groove,
 (0.55*greatest(tension - CASE WHEN lead(tension, 2) OVER w IS NOT NULL THEN (lead(tension) OVER w + lead(tension, 2) OVER w)/2 ELSE coalesce(lead(tension) OVER w, tension) END, 0) + 0.45*greatest(-({grad_t("tension")}), 0))
 * (0.7 + 0.3*CASE WHEN tension >= lag(tension) OVER w AND tension > lead(tension) OVER w THEN 1 ELSE 0 END) AS raw, greatest({grad("rn")}, 0) AS er, greatest({grad("bass_salience")}, 0) AS br FROM b {W}),
 r AS (SELECT *, {robust("raw")} AS release FROM h),
 curves AS (SELECT *, least(greatest(0.28*(1-rn) + 0.22*(1-bass_salience) + 0.18*(1-onset) + 0.16*tension + 0.1*(1-release) + 0.06*(1-groove), 0), 1) AS breakdown,
 least(greatest(0.32*release + 0.2*er + 0.16*br + 0.14*onset + 0.1*bass_salience + 0.08*groove, 0), 1) AS "drop" FROM r)"""


def curves_of(t):
    e = c("event_id")
    d = t.frames.select(
        "event_id", "track", "us", "t", c("value").alias("rms"), c("k").cast("double").alias("flux"), (e % 10 / 10.0).alias("onset"), (c("value") * c("k")).alias("bass"),
        (e % 7 / 7.0).alias("pulse"), (e % 5 / 5.0).alias("vocal"), (e % 3 / 3.0).alias("sync"), (e % 4 / 8.0).alias("micro"),
    )
    return op.descriptor_curves(d, "track", t.frame_bins)


@query(
    "descriptor_curves",
    f'WITH {CURVES} SELECT event_id, round(bass_salience, 6) + 0.0 AS bass_salience, round(tension, 6) + 0.0 AS tension, round(release, 5) + 0.0 AS release, round(groove, 6) + 0.0 AS groove, round(breakdown, 5) + 0.0 AS breakdown, round("drop", 5) + 0.0 AS "drop" FROM curves',
)
def _(t):
    d = curves_of(t)
    return d.select("event_id", *[rounded(c(n)).alias(n) for n in ("bass_salience", "tension", "groove")], *[rounded(c(n), 5).alias(n) for n in ("release", "breakdown", "drop")])


@query(
    "relabel_segments",
    f"""WITH {CURVES}, s AS (SELECT event_id AS iid, track, t - 100 AS start, t + 36000 AS "end", CASE event_id % 4 WHEN 0 THEN 'intro' WHEN 1 THEN 'drop' ELSE 'groove' END AS kind FROM frames WHERE label = 'error'),
 m AS (SELECT iid, avg(breakdown) AS b, avg("drop") AS d, avg(rn) AS e, avg(release) AS r, arg_max(rn, t) - arg_min(rn, t) AS s FROM s JOIN curves c ON c.track = s.track AND c.t BETWEEN s.start AND s."end" GROUP BY 1)
 SELECT iid, CASE WHEN kind = 'intro' THEN kind WHEN b >= 0.58 AND b >= d + 0.06 AND e <= 0.58 THEN 'breakdown' WHEN d >= 0.58 AND (d >= b OR r >= 0.55) THEN 'drop' WHEN m.s >= 0.08 AND e < 0.72 THEN 'build'
 WHEN kind <> 'drop' THEN 'groove' ELSE kind END AS label FROM s JOIN m USING (iid)""",
)
def _(t):
    k = c("event_id") % 4
    segs = t.frames.filter(c("label") == "error").select(
        c("event_id").alias("iid"), "track", (c("t") - 100).alias("start"), (c("t") + 36000).alias("end"), F.when(k == 0, "intro").when(k == 1, "drop").otherwise("groove").alias("kind")
    )
    return op.relabel_segments(segs, curves_of(t), "track", 3600.0).select("iid", "label")


@query(
    "event_density",
    f"WITH {FRAMES} SELECT q.event_id AS qid, round(count(e.event_id)/7200.0::DOUBLE, 8) + 0.0 AS rate FROM (SELECT * FROM frames WHERE label = 'error') q LEFT JOIN frames e ON e.track = q.track AND e.t BETWEEN q.t - 3600 AND q.t + 3600 GROUP BY 1",
)
def _(t):
    q = t.frames.filter(c("label") == "error").select(c("event_id").alias("qid"), "track", "t")
    return op.event_density(q, t.frames, "track", 7200.0, 3600.0).select("qid", rounded(c("rate"), 8).alias("rate"))


@query(
    "offbeat_and_microtiming",
    f"""WITH {FRAMES}, o AS (SELECT event_id, track, t FROM frames WHERE label <> 'view'), b AS (SELECT track, t, lead(t) OVER w AS nt FROM frames WHERE label = 'view' {W}), p AS (SELECT track, median(nt - t) AS period FROM b WHERE nt > t GROUP BY 1),
 h AS (SELECT track, (t + nt)/2 AS t FROM b WHERE nt IS NOT NULL),
 n AS (SELECT o.*, b1.t AS bt, b2.t AS nt, h1.t AS ht, h2.t AS mt FROM o ASOF LEFT JOIN b b1 ON b1.track = o.track AND b1.t <= o.t ASOF LEFT JOIN b b2 ON b2.track = o.track AND b2.t >= o.t ASOF LEFT JOIN h h1 ON h1.track = o.track AND h1.t <= o.t ASOF LEFT JOIN h h2 ON h2.track = o.track AND h2.t >= o.t),
 d AS (SELECT *, CASE WHEN nt IS NULL OR coalesce(t - bt <= nt - t, false) THEN t - bt ELSE t - nt END AS dev, least(t - ht, mt - t) AS off, floor(t/21600)::BIGINT AS slot FROM n JOIN p USING (track)),
 s AS (SELECT track, slot, count(*) AS n, avg(least(greatest((abs(dev) - off)/(0.5*period), 0), 1)) AS sync FROM d GROUP BY 1, 2), cl AS (SELECT * FROM d WHERE abs(dev) <= 0.15*period + 1e-9),
 ms AS (SELECT track, slot, least(median(abs(dev - m))/(0.18*any_value(period)), 1) AS own FROM (SELECT *, median(dev) OVER (PARTITION BY track, slot) AS m FROM cl) GROUP BY 1, 2),
 mw AS (SELECT track, least(median(abs(dev - m))/(0.18*any_value(period)), 1) AS whole FROM (SELECT *, median(dev) OVER (PARTITION BY track) AS m FROM cl) GROUP BY 1)
 SELECT track, slot, n, round(sync, 6) + 0.0 AS sync, round(coalesce(own, whole, 0), 6) + 0.0 AS micro FROM s LEFT JOIN ms USING (track, slot) LEFT JOIN mw USING (track)""",
)
def _(t):
    onsets = t.frames.filter(c("label") != "view").select("track", "t")
    beats = t.frames.filter(c("label") == "view").select("track", "t")
    d = op.offbeat_and_microtiming(onsets, beats, "track", [F.floor(c("t") / 3600)], 21600.0, 3600.0)
    return r6(d, ("sync", "micro"), ("track", "slot", "n"))


def beats_of(t):
    """A near-regular beat series per track, derived from the frames' order."""
    from seguelake import grouping

    placed = grouping.position(t.frames, ["track"], ["us"], t.frame_bins, "i")
    return placed.select("track", (c("i") * (0.5 + 0.0001 * (c("track") % 7)) + c("k") / 5000.0).alias("t"))


BEATS = f"""{FRAMES}, bt AS (SELECT track, row_number() OVER (PARTITION BY track ORDER BY us) * (0.5::DOUBLE + 0.0001::DOUBLE * (track % 7)) + k / 5000.0::DOUBLE AS t FROM frames)"""


@query(
    "long_span_tempo",
    f"""WITH {BEATS}, p AS (SELECT track, (lead(t, 32) OVER w - t)/32 AS period FROM bt {W}), q AS (SELECT * FROM p WHERE period > 0), m AS (SELECT track, median(period) AS mid, count(*) AS spans FROM q GROUP BY 1),
 a AS (SELECT track, median(abs(period - mid)) AS mad FROM q JOIN m USING (track) GROUP BY 1), r AS (SELECT DISTINCT track, 118.0::DOUBLE + track % 9 AS raw FROM frames),
 s AS (SELECT r.track, coalesce(spans, 0) AS spans, raw, 60/mid AS cand, CASE WHEN coalesce(spans, 0) < 8 THEN 'insufficient_beat_spans' WHEN 1.4826*mad/mid > 0.01 THEN 'unstable_long_span_tempo' WHEN abs(60/mid - raw)/raw > 0.05 THEN 'candidate_changes_metric_level' ELSE 'accepted' END AS reason
 FROM r LEFT JOIN m USING (track) LEFT JOIN a USING (track)) SELECT track, spans, reason, round(CASE reason WHEN 'accepted' THEN cand ELSE raw END, 6) AS bpm FROM s""",
)
def _(t):
    raw = t.frames.select("track", (F.lit(118.0) + c("track") % 9).alias("raw_bpm")).distinct()
    d = op.long_span_tempo(beats_of(t), raw, "track", [F.floor(c("t") / 64)])
    return r6(d, ("bpm",), ("track", "spans", "reason"))


@query(
    "phase_audit",
    f"""WITH {BEATS}, mk AS (SELECT track, min(t) + 0.1 AS t, 120.0::DOUBLE AS bpm, 1 AS beat FROM bt GROUP BY 1 UNION ALL SELECT track, min(t) + 12, 119.5, 3 FROM bt GROUP BY 1), f AS (SELECT track, min(t) AS ft FROM mk GROUP BY 1),
 j AS (SELECT b.track, b.t, coalesce(m.t, f.ft) AS mt, coalesce(m.bpm, 120) AS bpm, coalesce(m.beat, 1) AS beat FROM bt b ASOF LEFT JOIN mk m ON m.track = b.track AND m.t <= b.t JOIN f ON f.track = b.track),
 p AS (SELECT track, t, (beat - 1) + (t - mt)*bpm/60 AS pos FROM j) SELECT track, count(*) AS n, CAST(((round_even(arg_min(pos, t), 0)::BIGINT % 4) + 4) % 4 + 1 AS BIGINT) AS first_beat, round(median(abs(pos - round_even(pos, 0))), 6) + 0.0 AS p50, round(quantile_cont(abs(pos - round_even(pos, 0)), 0.9), 6) + 0.0 AS p90 FROM p GROUP BY track""",
)
def _(t):
    beats = beats_of(t)
    first = beats.groupBy("track").agg(F.min("t").alias("t0"))
    mark = lambda shift, bpm, beat: first.select("track", (c("t0") + shift).alias("t"), F.lit(bpm).alias("bpm"), F.lit(beat).alias("beat"))
    d = op.phase_audit(beats, mark(0.1, 120.0, 1).unionByName(mark(12.0, 119.5, 3)), "track", 64.0)
    return r6(d, ("p50", "p90"), ("track", "n", "first_beat"))


STEPS = f"""{SLOTS}, {TRACKS}, st AS (SELECT mix, position, vocal AS risk, bpm, CASE WHEN energy < 0.33 THEN 'low' WHEN energy < 0.67 THEN 'mid' ELSE 'high' END AS region FROM slots JOIN tracks USING (track))"""


@query(
    "sequence_guardrails",
    f"""WITH {STEPS}, x AS (SELECT *, lag(risk) OVER w AS pr, region = lag(region) OVER w AS same FROM st WINDOW w AS (PARTITION BY mix ORDER BY position)), y AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY mix ORDER BY position) AS run FROM x),
 k AS (SELECT mix, arg_max(n, (n, -f)) AS streak, arg_max(region, (n, -f)) AS region FROM (SELECT mix, run, any_value(region) AS region, count(*) AS n, min(position) AS f FROM y GROUP BY 1, 2) GROUP BY 1),
 b AS (SELECT mix, avg(risk) AS risk, coalesce(arg_max(risk >= 0.68 AND pr >= 0.68, position), false) AS two, (max(bpm) - min(bpm))/arg_min(bpm, position) AS span FROM x GROUP BY 1),
 z AS (SELECT *, CASE mix % 4 WHEN 0 THEN 'build' WHEN 1 THEN 'flat' WHEN 2 THEN 'peak' ELSE 'closing' END AS arc FROM b JOIN k USING (mix)),
 l AS (SELECT *, CASE arc WHEN 'build' THEN 0.06 WHEN 'flat' THEN 0.04 WHEN 'peak' THEN 0.08 ELSE 0.10 END::DOUBLE AS lim, CASE arc WHEN 'build' THEN 2 WHEN 'flat' THEN 4 WHEN 'peak' THEN CASE WHEN region = 'high' THEN 4 ELSE 3 END ELSE 3 END AS reach FROM z)
 SELECT mix, arc, round(risk, 6) + 0.0 AS risk, round(span, 6) + 0.0 AS span, streak, region,
 array_to_string(list_filter([CASE WHEN risk >= 0.48 THEN 'soft_risk' END, CASE WHEN risk >= 0.62 THEN 'hard_risk' END, CASE WHEN two THEN 'two_high_risks' END, CASE WHEN span > lim THEN 'drift' END, CASE WHEN span > lim + 0.04::DOUBLE THEN 'severe_drift' END, CASE WHEN streak > reach THEN 'streak' END, CASE WHEN streak > reach + 1 THEN 'long_streak' END], lambda f: f IS NOT NULL), ',') AS flags,
 round((CASE WHEN risk >= 0.48 THEN 0.10 ELSE 0 END + CASE WHEN risk >= 0.62 THEN 0.12 ELSE 0 END + CASE WHEN two THEN 0.14 ELSE 0 END + CASE WHEN span > lim THEN 0.10 ELSE 0 END + CASE WHEN span > lim + 0.04::DOUBLE THEN 0.12 ELSE 0 END + CASE WHEN streak > reach THEN 0.08 ELSE 0 END + CASE WHEN streak > reach + 1 THEN 0.10 ELSE 0 END)::DOUBLE, 6) + 0.0 AS penalty,
 risk >= 0.62 OR two OR span > lim + 0.04::DOUBLE OR streak > reach + 1 AS severe FROM l""",
)
def _(t):
    region = F.when(c("energy") < 0.33, "low").when(c("energy") < 0.67, "mid").otherwise("high")
    d = t.slots().join(t.tracks, "track").select("mix", "position", c("vocal").alias("risk"), "bpm", region.alias("region"))
    k = c("mix") % 4
    arc = F.when(k == 0, "build").when(k == 1, "flat").when(k == 2, "peak").otherwise("closing")
    out = op.sequence_guardrails(d, "mix", "position", t.slot_bins, arc)
    return r6(out, ("risk", "span", "penalty"), ("mix", "arc", "streak", "region", "flags", "severe"))


@query(
    "recency_weighted_history",
    f"""WITH {FRAMES}, r AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY us DESC) AS b FROM frames), l AS (SELECT *, count(*) OVER (PARTITION BY track) AS n FROM r WHERE b <= 6), w AS (SELECT track, value AS v, (n - b)::DOUBLE AS i, CASE WHEN n > 1 THEN 1.0 + (n - b)/(n - 1) ELSE 1.0 END AS w FROM l)
 SELECT track, count(*) AS n, round(sum(w*v)/sum(w), 6) AS mean, round(coalesce(regr_slope(v, i), 0), 6) + 0.0 AS slope FROM w GROUP BY track""",
)
def _(t):
    return r6(op.recency_summary(t.frames, "track", "us", "value", 6), ("mean", "slope"), ("track", "n"))


PATH = f"""{FRAMES}, pa AS (SELECT track, us, sum(CASE WHEN event_id % 13 = 0 THEN 0 ELSE 1 END) OVER w AS x, sum(CASE WHEN event_id % 17 = 0 THEN 2 ELSE 1 END) OVER w AS y FROM frames WINDOW w AS (PARTITION BY track ORDER BY us)),
 st AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM pa WINDOW w AS (PARTITION BY track ORDER BY us)), dg AS (SELECT *, nx - x = 1 AND ny - y = 1 AS diag FROM st WHERE nx IS NOT NULL),
 gr AS (SELECT *, sum(CASE WHEN diag THEN 0 ELSE 1 END) OVER (PARTITION BY track ORDER BY us) AS grp FROM dg), rn AS (SELECT track, grp, count(*) AS len, arg_min(x, us) AS ix, arg_min(y, us) AS iy, arg_max(nx, us) AS ox, arg_max(ny, us) AS oy, min(us) AS at_ FROM gr WHERE diag GROUP BY 1, 2),
 cues AS (SELECT track, tier, CAST(arg_min(ix, at_) AS BIGINT) AS track_in, CAST(arg_min(iy, at_) AS BIGINT) AS mix_in, arg_min(len, at_) AS run_in, CAST(arg_max(ox, at_) AS BIGINT) AS track_out, CAST(arg_max(oy, at_) AS BIGINT) AS mix_out, arg_max(len, at_) AS run_out FROM rn, (VALUES (16), (8), (4)) v(tier) WHERE len >= tier GROUP BY 1, 2)"""


def paths_of(t):
    from seguelake import grouping

    step = lambda n, a: F.when(c("event_id") % n == 0, a).otherwise(1)
    return grouping.running(t.frames, ["track"], ["us"], t.frame_bins, sums={"x": step(13, 0), "y": step(17, 2)}).select("track", "us", "x", "y")


def cues_of(t):
    return op.diagonal_runs(paths_of(t), "track", "us", t.frame_bins, (16, 8, 4))


@query("diagonal_runs", f"WITH {PATH} SELECT * FROM cues")
def _(t):
    return cues_of(t)[0]


@query("diagonal_match_rate", f"WITH {PATH} SELECT track, count(*) AS steps, round(avg(diag::INT::DOUBLE), 6) AS match_rate FROM dg GROUP BY track")
def _(t):
    return cues_of(t)[1].select("track", "steps", rounded(c("match_rate")).alias("match_rate"))


@query(
    "transition_evidence",
    f"""WITH {PATH}, q AS (SELECT track AS item, tier, mix_in, mix_out, round(0.2/(1.0::DOUBLE + track/100.0::DOUBLE) + 0.2*0.8 + 0.2*least(run_in/32.0::DOUBLE, 1) + 0.2*coalesce(CASE WHEN track % 5 <> 0 THEN 0.9 END, 0) + 0.2*0.7, 8) AS ci,
 round(0.2/(1.0::DOUBLE + track/100.0::DOUBLE) + 0.2*0.8 + 0.2*least(run_out/32.0::DOUBLE, 1) + 0.2*coalesce(CASE WHEN track % 5 <> 0 THEN 0.9 END, 0) + 0.2*0.7, 8) AS co, track % 9 <> 0 AS matched FROM cues)
 SELECT a.item AS pair, a.tier, b.mix_in - a.mix_out AS length, CAST(a.mix_out + floor((b.mix_in - a.mix_out)/2) AS BIGINT) AS middle, round(least(a.co, b.ci), 6) AS confidence, a.matched AND b.matched AND b.mix_in >= a.mix_out AS valid,
 array_to_string(list_filter([CASE WHEN NOT a.matched THEN 'previous_below_threshold' END, CASE WHEN NOT b.matched THEN 'next_below_threshold' END, CASE WHEN b.mix_in < a.mix_out THEN 'cue_order_reversed' END], lambda f: f IS NOT NULL), ',') AS warnings
 FROM q a JOIN q b ON b.item = a.item + 1 AND b.tier = a.tier""",
)
def _(t):
    cues, _ = cues_of(t)
    conf = lambda run: op.boundary_confidence(c("track") / 100.0, F.lit(0.8), c(run), F.when(c("track") % 5 != 0, 0.9), F.lit(0.7))
    q = cues.select(c("track").alias("item"), "tier", "mix_in", "mix_out", conf("run_in").alias("conf_in"), conf("run_out").alias("conf_out"), (c("track") % 9 != 0).alias("matched"))
    pairs = q.select(c("item").alias("pair"), c("item").alias("a"), (c("item") + 1).alias("b")).distinct()
    return op.transition_evidence(pairs, q).withColumn("confidence", rounded(c("confidence")))


OVERLAP = f"""{SLOTS}, pl AS (SELECT mix, position, track, CASE WHEN qty <> 9 THEN position*100 - qty*2 END AS mix_in, position*100 + qty*3 AS mix_out FROM slots)"""


@query(
    "overlap_observations",
    f"""WITH {OVERLAP}, n AS (SELECT mix, position, track, lead(track) OVER w AS next_track, mix_out - lead(mix_in) OVER w AS overlap FROM pl WINDOW w AS (PARTITION BY mix ORDER BY position))
 SELECT mix, position, track, next_track, overlap, CAST(CASE WHEN overlap <= 48 THEN 32 WHEN overlap <= 80 THEN 64 WHEN overlap <= 112 THEN 96 WHEN overlap <= 144 THEN 128 WHEN overlap <= 176 THEN 160 WHEN overlap <= 208 THEN 192 WHEN overlap <= 240 THEN 224 ELSE 256 END AS INTEGER) AS bucket FROM n WHERE overlap > 0 AND overlap <= 256""",
)
def _(t):
    d = t.slots("qty").select("mix", "position", "track", F.when(c("qty") != 9, c("position") * 100 - c("qty") * 2).alias("mix_in"), (c("position") * 100 + c("qty") * 3).alias("mix_out"))
    return op.overlap_observations(d, "mix", "position", t.slot_bins).select("mix", "position", "track", "next_track", "overlap", "bucket")


@query(
    "anchor_interpolation",
    f"""WITH {SLOTS}, a AS (SELECT mix, position, CASE WHEN track % 3 = 0 THEN position*1000 + CAST(qty AS BIGINT) END AS ms FROM slots), b AS (SELECT *, last_value(CASE WHEN ms IS NOT NULL THEN position END IGNORE NULLS) OVER w AS lp, last_value(ms IGNORE NULLS) OVER w AS lt,
 first_value(CASE WHEN ms IS NOT NULL THEN position END IGNORE NULLS) OVER v AS rp, first_value(ms IGNORE NULLS) OVER v AS rt FROM a WINDOW w AS (PARTITION BY mix ORDER BY position ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY mix ORDER BY position ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
 SELECT mix, position, CASE WHEN ms IS NOT NULL THEN ms WHEN lp IS NOT NULL AND rp IS NOT NULL THEN CAST(floor(lt + (position - lp)/(rp - lp)*(rt - lt)) AS BIGINT) END AS found, CASE WHEN ms IS NOT NULL THEN 'measured' WHEN lp IS NOT NULL AND rp IS NOT NULL THEN 'interpolated' ELSE 'none' END AS how FROM b""",
)
def _(t):
    d = t.slots("qty").select("mix", "position", F.when(c("track") % 3 == 0, c("position") * 1000 + c("qty").cast("long")).alias("ms"))
    return op.anchor_interpolation(d, "mix", "position", t.slot_bins, "ms").select("mix", "position", "found", "how")


@query(
    "phrase_anchors",
    f"""WITH {BEATS}, n AS (SELECT *, row_number() OVER w AS i FROM bt {W}), bd AS (SELECT DISTINCT track, k + 0.25::DOUBLE AS t FROM frames WHERE label = 'error'), s AS (SELECT d.track, CASE WHEN a.t IS NULL OR coalesce(d.t - b.t <= a.t - d.t, false) THEN b.t ELSE a.t END AS t
 FROM bd d ASOF LEFT JOIN bt b ON b.track = d.track AND b.t <= d.t ASOF LEFT JOIN bt a ON a.track = d.track AND a.t >= d.t) SELECT DISTINCT track, round(t, 4) AS t FROM (SELECT track, t FROM n WHERE (i - 1) % 32 = 0 UNION ALL SELECT track, t FROM s) WHERE t IS NOT NULL""",
)
def _(t):
    bounds = t.frames.filter(c("label") == "error").select("track", (c("k") + 0.25).alias("t"))
    return op.phrase_anchors(beats_of(t), bounds, "track", [F.floor(c("t") / 64)], 64.0)


@query(
    "stability_runway",
    f"""WITH {FRAMES}, f AS (SELECT track, t, 50 + value/10 AS rms, lag(50 + value/10) OVER w AS pr, lag(t) OVER w AS pt FROM frames {W}), cu AS (SELECT event_id AS iid, track, t AS start, t + 256*60/0.05::DOUBLE AS "end" FROM frames WHERE label = 'error'),
 a AS (SELECT cu.*, f.t, rms, pr, pt FROM cu JOIN f ON f.track = cu.track AND f.t BETWEEN cu.start AND cu."end"), g AS (SELECT iid, min(t) AS ft, arg_min(rms, t) AS fr, count(*) AS n, max(t) AS last FROM a GROUP BY 1),
 z AS (SELECT iid, arg_min(pt, t) AS stop FROM a JOIN g USING (iid) WHERE t > ft AND (abs(rms - pr)/greatest(pr, fr, 1e-9) > 0.35 OR abs(rms - fr)/fr > 0.5) GROUP BY 1),
 r AS (SELECT cu.iid, CASE WHEN n >= 2 THEN least((coalesce(stop, last) - start)*0.05::DOUBLE/60, 256) END AS runway FROM cu LEFT JOIN g USING (iid) LEFT JOIN z USING (iid))
 SELECT iid, round(runway, 6) + 0.0 AS runway, CAST(CASE WHEN runway IS NOT NULL THEN greatest(32, least(256, floor(runway/32)*32)) END AS INTEGER) AS suggested FROM r""",
)
def _(t):
    frames = t.frames.select("track", "t", (50 + c("value") / 10).alias("rms"))
    cues = t.frames.filter(c("label") == "error").select("track", c("event_id").alias("iid"), "t", F.lit(0.05).alias("bpm"))
    d = op.stability_runway(frames, cues, "track", [F.floor(c("t") / 3600)], 86400.0)
    return d.select("iid", rounded(c("runway")).alias("runway"), "suggested")


@query(
    "set_coherence",
    f"""WITH {SLOTS}, {TRACKS}, s AS (SELECT mix, position, bpm, energy, CASE WHEN mix % 3 <> 0 THEN least(position/10.0::DOUBLE, 1) END AS target, lag(bpm) OVER (PARTITION BY mix ORDER BY position) AS pb FROM slots JOIN tracks USING (track)),
 g AS (SELECT mix, count(*) AS n, avg(abs(bpm - pb)/pb) AS jump, avg(abs(energy - target)) AS mae FROM s GROUP BY 1), v AS (SELECT mix, coalesce(least(greatest(1 - jump/0.10, 0), 1), 0.5) AS tc, CASE WHEN mae IS NOT NULL THEN least(greatest(1 - 2*mae, 0), 1) END AS arc FROM g WHERE n >= 2)
 SELECT mix, round(arc, 6) + 0.0 AS arc_adherence, round(tc, 6) + 0.0 AS tempo_continuity, round(CASE WHEN arc IS NULL THEN tc ELSE 0.5*arc + 0.5*tc END, 6) + 0.0 AS overall FROM v""",
)
def _(t):
    d = t.slots().join(t.tracks, "track").withColumn("target", F.when(c("mix") % 3 != 0, F.least(c("position") / 10.0, F.lit(1.0))))
    out = op.set_coherence(d.select("mix", "position", "energy", "bpm", "target"), "mix", "position", t.slot_bins)
    return r6(out, ("arc_adherence", "tempo_continuity", "overall"), ("mix",))


@query(
    "set_diversity_warnings",
    f"""WITH {SLOTS}, {TRACKS}, s AS (SELECT mix, position, release, style, energy, vocal, lag(style) OVER w AS ps, lag(energy) OVER w AS pe FROM slots JOIN tracks USING (track) WINDOW w AS (PARTITION BY mix ORDER BY position)),
 r AS (SELECT mix, count(*) FILTER (n > 2) AS crowded_releases FROM (SELECT mix, release, count(*) AS n FROM s GROUP BY 1, 2) GROUP BY 1), a AS (SELECT mix, count(*) FILTER (n > 1) AS repeated_artists FROM (SELECT mix, style, count(*) AS n FROM s GROUP BY 1, 2) GROUP BY 1)
 SELECT mix, any_value(crowded_releases) AS crowded_releases, any_value(repeated_artists) AS repeated_artists, count(*) FILTER (style = ps) AS adjacent_artists, count(*) FILTER (energy - pe < -0.08) AS energy_drops, count(*) FILTER (vocal < 0.6) AS weak_seams FROM s JOIN r USING (mix) JOIN a USING (mix) GROUP BY mix""",
)
def _(t):
    d = t.slots().join(t.tracks, "track").select("mix", "position", "release", c("style").alias("artist"), "energy", c("vocal").alias("score"))
    return op.set_warnings(d, "mix", "position", t.slot_bins)


def plan_sql(shares):
    rows = ", ".join(f"({i + 1}, {s!r}::DOUBLE)" for i, s in enumerate(shares))
    return f"""WITH {TRACKS}, b AS (SELECT style, list_sort(list(bpm)) AS l, quantile_cont(bpm, 0.1) AS lo, quantile_cont(bpm, 0.9) AS hi, count(*) AS n FROM tracks GROUP BY 1), v(slot, s) AS (VALUES {rows}),
 x AS (SELECT style, slot, lo, hi, l, s*(n-1) AS r FROM b, v WHERE n >= 2) SELECT style, slot, round(CASE WHEN hi - lo < 0.5 THEN lo ELSE l[floor(r)::INT+1] + (l[ceil(r)::INT+1] - l[floor(r)::INT+1])*(r - floor(r)) END, 6) AS bpm FROM x"""


@query("tempo_plan", plan_sql([i / 9 for i in range(10)]))
def _(t):
    return r6(op.tempo_plan(t.tracks, ["style"], "linear", 10), ("bpm",), ("style", "slot"))


@query("tempo_plan_stairs", plan_sql([x / 3 for x in (0, 0, 0, 0, 1, 2, 3, 3, 3, 3)]))
def _(t):
    return r6(op.tempo_plan(t.tracks, ["style"], "staircase", 10), ("bpm",), ("style", "slot"))


@query(
    "target_arc_profile",
    f"""WITH {TRACKS}, q AS (SELECT style, quantile_cont(energy, 0.15) AS a, quantile_cont(energy, 0.85) AS b FROM tracks GROUP BY 1) SELECT style, CAST(i + 1 AS INTEGER) AS slot, round(least(greatest(a + (greatest(a, b) - a)*power(i/7.0::DOUBLE, 1.15), 0), 1), 6) AS target FROM q, range(0, 8) r(i)""",
)
def _(t):
    return r6(op.target_arc(t.tracks, ["style"], "build", 8), ("target",), ("style", "slot"))


@query(
    "per_second_sources",
    f"""WITH {BEATS}, f AS (SELECT track, t, t - floor(t) AS activity FROM bt), g AS (SELECT *, abs({grad("activity")}) AS g FROM f {W}), m AS (SELECT *, max(g) OVER (PARTITION BY track) AS top FROM g)
 SELECT track, CAST(floor(t) AS BIGINT) AS second, round(avg(activity), 6) AS activity, round(avg(CASE WHEN top <= 1e-9 THEN 1 ELSE least(greatest(1 - g/top, 0), 1) END), 6) + 0.0 AS continuity FROM m GROUP BY 1, 2""",
)
def _(t):
    d = beats_of(t).withColumn("activity", c("t") - F.floor("t"))
    return r6(op.per_second_sources(d, "track", [F.floor(c("t") / 64)]), ("activity", "continuity"), ("track", "second"))


RUNS = f"""WITH RECURSIVE {SLOTS}, q AS (SELECT mix, position, track % 40 AS item, track % 30 AS audio, qty <> 7 AS ok FROM slots),
 walk AS (SELECT mix, position, item, audio, ok, CASE WHEN ok THEN 1 ELSE 0 END AS run, CASE WHEN ok THEN [item] ELSE [] END AS si, CASE WHEN ok THEN [audio] ELSE [] END AS sa FROM q WHERE position = 1
 UNION ALL SELECT q.mix, q.position, q.item, q.audio, q.ok, w.run + CASE WHEN q.ok AND (len(w.si) = 0 OR list_contains(w.si, q.item) OR list_contains(w.sa, q.audio)) THEN 1 ELSE 0 END,
 CASE WHEN NOT q.ok THEN [] WHEN list_contains(w.si, q.item) OR list_contains(w.sa, q.audio) THEN [q.item] ELSE list_append(w.si, q.item) END,
 CASE WHEN NOT q.ok THEN [] WHEN list_contains(w.si, q.item) OR list_contains(w.sa, q.audio) THEN [q.audio] ELSE list_append(w.sa, q.audio) END FROM walk w JOIN q ON q.mix = w.mix AND q.position = w.position + 1),
 runs AS (SELECT * FROM (SELECT mix, position, item, CAST(run AS BIGINT) AS run, count(*) OVER (PARTITION BY mix, run) AS run_len FROM walk WHERE ok) WHERE run_len >= 3)"""


def runs_of(t):
    d = t.slots("qty").select("mix", "position", (c("track") % 40).alias("item"), (c("track") % 30).alias("audio"), (c("qty") != 7).alias("qualified"))
    return op.contiguous_runs(d, "mix", "position", t.slot_bins, ["item", "audio"])


@query("contiguous_runs", f"{RUNS} SELECT mix, position, item, run, run_len FROM runs")
def _(t):
    return runs_of(t).select("mix", "position", "item", "run", "run_len")


@query(
    "choice_observations",
    f"""{RUNS}, o AS (SELECT *, row_number() OVER w AS k, CAST(sum(item) OVER w AS BIGINT) AS seen, CAST(sum(item) OVER (PARTITION BY mix, run) AS BIGINT) AS total FROM runs WINDOW w AS (PARTITION BY mix, run ORDER BY position))
 SELECT mix, run, position, item AS selected, k - 1 AS n_history, run_len - k + 1 AS n_candidates, seen - item AS history_sum, total - seen + item AS candidate_sum FROM o WHERE k >= 2 AND k < run_len""",
)
def _(t):
    return op.choice_observations(runs_of(t), "mix", "position", t.slot_bins, "item")


@query(
    "observation_members",
    f"""{RUNS}, o AS (SELECT *, row_number() OVER w AS k FROM runs WINDOW w AS (PARTITION BY mix, run ORDER BY position))
 SELECT a.mix, a.run, a.position, CASE WHEN b.k < a.k THEN 'history' ELSE 'candidate' END AS role, CAST(b.k - 1 AS BIGINT) AS place, b.item, b.k = a.k AS picked FROM o a JOIN o b ON a.mix = b.mix AND a.run = b.run WHERE a.k >= 2 AND a.k < a.run_len""",
)
def _(t):
    runs = cut_lineage(runs_of(t))
    picks = op.choice_observations(runs, "mix", "position", t.slot_bins, "item").select("mix", "run", "position", "n_history", "n_candidates")
    chunks = histories.chunked(runs, ["mix", "run"], [c("position")], ["item", "position"])
    d = histories.members(histories.observation_references(picks, ["mix", "run"]), chunks, ["mix", "run"])
    return d.select("mix", "run", "position", "role", c("member.place").alias("place"), c("member.item").alias("item"), (c("member.position") == c("position")).alias("picked"))


@query(
    "monotone_anchors",
    f"""WITH RECURSIVE {FRAMES}, m AS (SELECT track, t, k AS pos, row_number() OVER (PARTITION BY track ORDER BY t, k DESC) AS n FROM frames WHERE k IS NOT NULL),
 w AS (SELECT track, 0::BIGINT AS n, []::INTEGER[] AS poss, []::BIGINT[] AS lens, []::BIGINT[] AS links FROM m GROUP BY track
  UNION ALL SELECT track, n, list_append(poss, pos), list_append(lens, best + 1), list_append(links, coalesce([i FOR i IN range(1, n) IF poss[i] < pos AND lens[i] = best][1], 0))
  FROM (SELECT w.track, m.n, m.pos, w.poss, w.lens, w.links, coalesce(list_max([w.lens[i] FOR i IN range(1, m.n) IF w.poss[i] < m.pos]), 0) AS best FROM w JOIN m ON m.track = w.track AND m.n = w.n + 1) x),
 z AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY track ORDER BY n DESC) = 1),
 c AS (SELECT track, list_position(lens, list_max(lens))::BIGINT AS i, links, lens FROM z UNION ALL SELECT track, links[i], links, lens FROM c WHERE links[i] > 0)
 SELECT c.track, m.t, m.pos::BIGINT AS pos, CAST(lens[i] AS INTEGER) AS level FROM c JOIN m ON m.track = c.track AND m.n = c.i""",
)
def _(t):
    return op.monotone_anchors(t.frames.select("track", "t", c("k").alias("pos")), "track")


@query("jump_contour")
def _(t):
    d = t.slots().join(t.mixes.select("mix", "dj"), "mix").withColumn("id", t.vector_of("track"))
    contour = op.jump_contour(d.select("dj", "mix", "position", "id"), t.vectors.select("id", "vec"), "dj", "mix", "position", t.slot_bins)
    return contour.select("dj", "mix", "position", rounded(c("cos")).alias("cos"))
