"""Queries on validation, catalogue checks and gates."""

from pyspark.sql import functions as F

from seguelake.bindings import MIXES, SLOTS, TRACKS
from seguelake.functions.numeric import rounded
from seguelake.operators import joins, quality as op
from seguelake.queries import query
from seguelake.queries.evaluation import r6
from seguelake.queries.joins import WINDOWS, windows_of
from seguelake.queries.pairs import slot_pairs
from seguelake.queries.series import BEATS, beats_of
from seguelake.bindings import PAIRS

c = F.col


@query(
    "validate_annotations",
    f"""WITH {WINDOWS}, {SLOTS}, {PAIRS}, tk AS (SELECT track, 130.0::DOUBLE AS duration, CASE WHEN track % 25 = 0 THEN '' ELSE title END AS path FROM tracks WHERE track % 10 <> 3),
 w AS (SELECT track * 10 + (start // 60)::BIGINT AS wid, track, start, CASE WHEN track % 30 = 0 THEN start - 1 ELSE "end" END AS "end" FROM win), p AS (SELECT mix * 100 + position AS pair, a, b, (a + b) % 5 + 1 AS rating, CASE WHEN a % 2 = 0 THEN 'ok' END AS comment FROM pairs),
 i AS (SELECT 'unknown_window_track' AS code, 'error' AS level FROM w WHERE track NOT IN (SELECT track FROM tk) UNION ALL SELECT 'reversed_window', 'error' FROM w WHERE start >= "end" UNION ALL SELECT 'window_past_end', 'error' FROM w JOIN tk USING (track) WHERE "end" > duration + 1
 UNION ALL SELECT 'unknown_pair_track', 'error' FROM p WHERE a NOT IN (SELECT track FROM tk) UNION ALL SELECT 'unknown_pair_track', 'error' FROM p WHERE b NOT IN (SELECT track FROM tk) UNION ALL SELECT 'unknown_role', 'error' FROM tracks WHERE release NOT IN ('ECONOMY', 'SMALL', 'LARGE')
 UNION ALL SELECT 'extreme_without_comment', 'warning' FROM p WHERE rating IN (1, 5) AND comment IS NULL UNION ALL SELECT 'missing_file', 'warning' FROM tk WHERE path = '') SELECT code, level, count(*) AS n FROM i GROUP BY 1, 2""",
)
def _(t):
    tracks = t.tracks.filter(c("track") % 10 != 3).select("track", F.lit(130.0).alias("duration"), F.when(c("track") % 25 == 0, "").otherwise(c("title")).alias("path"))
    w = windows_of(t).select((c("track") * 10 + F.floor(c("start") / 60)).alias("wid"), "track", "start", F.when(c("track") % 30 == 0, c("start") - 1).otherwise(c("end")).alias("end"))
    p = slot_pairs(t).select((c("mix") * 100 + c("position")).alias("pair"), "a", "b", ((c("a") + c("b")) % 5 + 1).alias("rating"), F.when(c("a") % 2 == 0, "ok").alias("comment"))
    roles = t.tracks.select("track", c("release").alias("role"))
    d = op.validate_annotations(tracks, w, p, roles, ["ECONOMY", "SMALL", "LARGE"])
    return d.groupBy("code", "level").agg(F.count(F.lit(1)).alias("n"))


RAW = f"""{SLOTS}, alb AS (SELECT o_orderkey AS album, (SELECT count(*) FROM slots WHERE mix = o_orderkey) + CASE WHEN o_orderkey % 50 = 0 THEN 1 ELSE 0 END AS n_tracks, 'C' || o_custkey AS creator FROM orders WHERE o_orderkey IN (SELECT mix FROM slots)
 UNION ALL SELECT o_orderkey, (SELECT count(*) FROM slots WHERE mix = o_orderkey), 'C' || o_custkey FROM orders WHERE o_orderkey % 70 = 0 AND o_orderkey IN (SELECT mix FROM slots)),
 rw AS (SELECT mix AS album, CASE WHEN mix % 60 = 0 AND position > 2 THEN position + 1 ELSE position END AS position, track AS song, CASE WHEN mix % 90 = 0 THEN 'other' ELSE 't' || track END AS title, CASE WHEN track % 8 <> 0 THEN 'A' || (track % 30) END AS artist FROM slots)"""


def raw_catalog(t, clean=False):
    slots = t.slots()
    m = lambda n: (c("mix") % n == 0) & F.lit(not clean)
    sizes = t.plays.groupBy("mix").agg(F.count(F.lit(1)).alias("k"))
    base = t.mixes.join(sizes, "mix").withColumn("creator", F.concat(F.lit("C"), c("dj")))
    albums = base.select(c("mix").alias("album"), (c("k") + F.when(m(50), 1).otherwise(0)).alias("n_tracks"), "creator")
    albums = albums.unionByName(base.filter(m(70)).select(c("mix").alias("album"), c("k").alias("n_tracks"), "creator"))
    rows = slots.select(
        c("mix").alias("album"), F.when(m(60) & (c("position") > 2), c("position") + 1).otherwise(c("position")).alias("position"), c("track").alias("song"),
        F.when(m(90), "other").otherwise(F.concat(F.lit("t"), c("track"))).alias("title"), F.when(c("track") % 8 != 0, F.concat(F.lit("A"), c("track") % 30)).alias("artist"),
    )
    return albums, rows


@query(
    "catalog_violations",
    f"""WITH {RAW}, z AS (SELECT album, count(*) AS n, max(position) AS top FROM rw GROUP BY 1) SELECT 'duplicate_album' AS code, count(*) AS n FROM (SELECT album FROM alb GROUP BY 1 HAVING count(*) > 1)
 UNION ALL SELECT 'count_mismatch', count(*) FROM z JOIN (SELECT album, max(n_tracks) AS k FROM alb GROUP BY 1) USING (album) WHERE n <> k UNION ALL SELECT 'positions_not_contiguous', count(*) FROM z WHERE top <> n UNION ALL SELECT 'conflicting_title', count(*) FROM (SELECT song FROM rw GROUP BY 1 HAVING count(DISTINCT title) > 1)""",
)
def _(t):
    return op.catalog_violations(*raw_catalog(t)).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query(
    "normalize_catalog",
    f"""WITH {SLOTS} SELECT mix AS album, position, track AS song, CASE WHEN track % 8 <> 0 THEN 'A' || (track % 30) ELSE 'C' || o_custkey END AS artist_used, CASE WHEN track % 8 <> 0 THEN 'row' ELSE 'album_creator' END AS credit_source, false AS placeholder FROM slots JOIN orders ON o_orderkey = mix""",
)
def _(t):
    return op.normalize_catalog(*raw_catalog(t, clean=True))["slots"]


@query(
    "ordering_readiness",
    f"""WITH {SLOTS}, {MIXES}, d AS (SELECT mix, position, track, CASE WHEN track % 20 <> 0 THEN 1 END AS f, CASE WHEN dj % 6 <> 0 THEN dj END AS dj FROM slots JOIN mixes USING (mix)), k AS (SELECT mix, count(*) FILTER (f IS NULL) AS g, max(dj) AS dj FROM d GROUP BY 1)
 SELECT count(*) AS cases, count(*) FILTER (g > 0) AS without_features, count(*) FILTER (dj IS NULL) AS without_identity, count(*) FILTER (g = 0 AND dj IS NOT NULL) AS eligible, count(DISTINCT CASE WHEN g = 0 AND dj IS NOT NULL THEN mix END) AS mixes,
 count(DISTINCT CASE WHEN g = 0 AND dj IS NOT NULL THEN dj END) AS djs, CASE WHEN count(*) FILTER (g = 0 AND dj IS NOT NULL) < 1000000 THEN 'too_few_cases' ELSE '' END AS blockers FROM k""",
)
def _(t):
    obs = t.plays.select(c("mix").alias("case"), "mix", c("track").alias("item"))
    feats = t.tracks.filter(c("track") % 20 != 0).select(c("track").alias("item"))
    djs = t.mixes.filter(c("dj") % 6 != 0).select("mix", "dj")
    return op.ordering_readiness(obs, feats, djs, 1_000_000, 20)


def reviewed(t):
    n = t.plays.groupBy("mix").agg(F.count(F.lit(1)).alias("n_tracks"))
    k = c("mix") % 12
    review = t.mixes.filter(k != 0).select("mix", F.when(k == 1, "rejected").otherwise("approved").alias("status"), F.when(k != 2, c("day")).alias("day"))
    review = review.unionByName(review.filter(k == 3))
    history = joins.strict_history(t.mixes, t.plays.select("mix", "track"), 3650).select("mix", "prior_sets")
    return op.review_reasons(n, review, history, 3)


REASONS = f"""{SLOTS}, {MIXES}, n AS (SELECT mix, count(*) AS n FROM slots GROUP BY 1), p AS (SELECT m.mix, count(q.mix) AS prior FROM mixes m LEFT JOIN mixes q ON q.dj = m.dj AND q.day < m.day GROUP BY 1),
 reasons AS (SELECT mix, CASE WHEN mix % 12 = 0 THEN 'undecided' WHEN mix % 12 = 3 THEN 'decided_twice' WHEN mix % 12 = 1 THEN 'rejected' WHEN mix % 12 = 2 THEN 'no_exact_date' WHEN n < 3 THEN 'too_short' WHEN prior = 0 THEN 'no_history' ELSE 'observation' END AS reason FROM n JOIN p USING (mix))"""


@query("repertoire_review", f"WITH {REASONS} SELECT reason, count(*) AS n FROM reasons GROUP BY 1")
def _(t):
    return reviewed(t).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("repertoire_gate", f"WITH {REASONS} SELECT count(*) AS cases, count(DISTINCT dj) AS djs, count(*) >= 100 AND count(DISTINCT dj) >= 20 AS open FROM reasons JOIN mixes USING (mix) WHERE reason = 'observation'")
def _(t):
    return op.review_gate(reviewed(t), t.mixes.select("mix", "dj"))


@query(
    "style_gap_buckets",
    """SELECT CASE WHEN p_size % 10 = 0 THEN 'not_music' WHEN p_partkey % 4 = 0 THEN 'found' WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 'artist_unknown' WHEN p_name LIKE '%red%' THEN 'version_title' ELSE 'plain_title' END AS bucket, count(*) AS n FROM part GROUP BY 1""",
)
def _(t):
    lib = t.raw("part").select(c("p_partkey").alias("id"), c("p_brand").alias("artist"), c("p_name").alias("title"), "p_size")
    known = lib.filter(~c("artist").isin("Brand#1", "Brand#2")).select("artist")
    return op.gap_buckets(lib, lib.filter(c("id") % 4 == 0), known, c("p_size") % 10 != 0, c("title").contains("red"))


@query(
    "beatgrid_diagnostics",
    f"""WITH {BEATS}, b AS (SELECT track, t, lead(t) OVER (PARTITION BY track ORDER BY t) - t AS gap, min(t) OVER (PARTITION BY track) AS t0, 118.0::DOUBLE + track % 5 AS bpm FROM bt),
 g AS (SELECT track, any_value(bpm) AS bpm, count(*) AS beats, avg(abs((t-t0)*bpm/60 - round_even((t-t0)*bpm/60, 0))*60/bpm) AS me, max(abs((t-t0)*bpm/60 - round_even((t-t0)*bpm/60, 0))*60/bpm) AS xe, max(t) - min(t) AS cov, stddev_pop(CASE WHEN gap > 0 THEN gap END)/avg(CASE WHEN gap > 0 THEN gap END) AS cv,
 count(*) FILTER (gap <= 0) AS bad, median(CASE WHEN gap > 0 THEN gap END) AS mid FROM b GROUP BY 1), m AS (SELECT *, abs(60/mid - bpm)/bpm*100 AS mm FROM g)
 SELECT track, beats, round(cv, 6) AS cv, round(me, 6) AS mean_error, round(xe, 6) AS max_error, round(cov, 6) AS coverage, round(mm, 5) + 0.0 AS mismatch,
 array_to_string(list_filter([CASE WHEN bad > 0 THEN 'non_monotonic_beats' END, CASE WHEN beats < 8 THEN 'insufficient_beats' END, CASE WHEN cov < 16 THEN 'short_beat_coverage' END, CASE WHEN cv > 0.12 THEN 'irregular_beat_intervals' END, CASE WHEN mm > 0.8 THEN 'grid_drift' END], lambda x: x IS NOT NULL), ',') AS flags FROM m""",
)
def _(t):
    tempos = t.frames.select("track", (F.lit(118.0) + c("track") % 5).alias("bpm")).distinct()
    d = op.grid_diagnostics(beats_of(t), tempos, "track", [F.floor(c("t") / 64)])
    return d.select("track", "beats", *[rounded(c(n)).alias(n) for n in ("cv", "mean_error", "max_error", "coverage")], rounded(c("mismatch"), 5).alias("mismatch"), "flags")


@query(
    "incremental_work_filter",
    """SELECT doc_id AS id, CASE WHEN doc_id % 9 = 0 THEN 'not_recorded' WHEN doc_id % 9 = 1 THEN 'failed_before' WHEN doc_id % 9 = 2 THEN 'artifact_missing' WHEN doc_id % 9 = 3 THEN 'source_changed' WHEN doc_id % 9 = 4 THEN 'engine_changed' WHEN doc_id % 9 = 5 THEN 'schema_changed'
 WHEN doc_id % 9 = 6 THEN 'formula_changed' WHEN doc_id % 9 = 7 THEN 'tier_too_low' ELSE 'reuse' END AS reason FROM documents""",
)
def _(t):
    k = c("doc_id") % 9
    inputs = t.documents.select(c("doc_id").alias("id"), F.sha2("text", 256).alias("checksum"))
    ledger = t.documents.filter(k != 0).select(
        c("doc_id").alias("id"), F.when(k == 1, "failed").otherwise("done").alias("status"), F.when(k != 2, F.concat(F.lit("a"), c("doc_id"))).alias("artifact"),
        F.when(k == 3, "old").otherwise(F.sha2("text", 256)).alias("checksum"), F.when(k == 4, "0").otherwise("1").alias("engine"), F.when(k == 5, "0").otherwise("1").alias("schema"),
        F.when(k == 6, "0").otherwise("1").alias("formula"), F.when(k == 7, "lean").otherwise("full").alias("tier"),
    )
    return op.incremental_work(inputs, ledger, "1", "1", "1", "standard")


@query(
    "file_inventory",
    """WITH f AS (SELECT CAST(doc_id AS VARCHAR) AS id, count(*) AS n, count(*) FILTER (e = 'wav') AS g FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'txt' ELSE 'wav' END AS e FROM documents WHERE doc_id % 6 <> 0 UNION ALL SELECT doc_id, 'wav' FROM documents WHERE doc_id % 7 = 1) GROUP BY 1)
 SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN n IS NULL THEN 'missing' WHEN g = 1 THEN 'resolved' WHEN g > 1 THEN 'ambiguous' ELSE 'unsupported' END AS status FROM documents LEFT JOIN f ON f.id = CAST(doc_id AS VARCHAR)""",
)
def _(t):
    d = t.documents
    ext = F.when(c("doc_id") % 5 == 0, ".txt").otherwise(".WAV")
    files = d.filter(c("doc_id") % 6 != 0).select(F.concat(F.lit("/audio/"), "source", F.lit("/"), c("doc_id"), ext).alias("path"))
    files = files.unionByName(d.filter(c("doc_id") % 7 == 1).select(F.concat(F.lit("/copy/"), c("doc_id"), F.lit(".wav")).alias("path")))
    return op.inventory_status(d.select(c("doc_id").alias("id")), files, ["wav", "flac"])
