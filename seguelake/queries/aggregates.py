"""Queries on profiles and summaries."""

from pyspark.sql import functions as F

from seguelake.bindings import FRAMES, MIXES, PAIRS, SLOTS, TRACKS, sql_relation, sql_whole_word
from seguelake.functions import harmony, tempo, text, vectors
from seguelake.functions.numeric import rounded
from seguelake.operators import aggregates as op
from seguelake.operators.pairs import with_track_features
from seguelake.queries import query
from seguelake.queries.pairs import slot_pairs

c = F.col


@query(
    "library_profile",
    f"""WITH {TRACKS} SELECT count(*) AS tracks, min(bpm) AS bpm_min, max(bpm) AS bpm_max, round(avg(bpm), 2) AS bpm_mean, 0::BIGINT AS missing_style,
 count(*) FILTER (lower(style) IN ('brand#3', 'brand#4')) AS preferred, count(*) FILTER (bpm BETWEEN 100 AND 120) AS in_tempo,
 (SELECT lower(style) FROM tracks GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS dominant_style FROM tracks""",
)
def _(t):
    return op.library_profile(t.tracks, ["brand#3", "brand#4"], 100, 120)


@query(
    "genre_coverage",
    """SELECT CASE WHEN grouping(p_type, p_brand) = 3 THEN 'all' ELSE p_type END AS section, CASE WHEN grouping(p_type, p_brand) >= 1 THEN 'all' ELSE p_brand END AS genre,
 count(*) AS n FROM part GROUP BY ROLLUP (p_type, p_brand)""",
)
def _(t):
    return op.genre_coverage(t.tracks, "release", "style")


TOPS = """, {0} AS (SELECT dj, string_agg(x || ':' || n, ',' ORDER BY n DESC, x) AS {0} FROM (SELECT *, row_number() OVER (PARTITION BY dj ORDER BY n DESC, x) AS rn FROM
 (SELECT dj, {1} AS x, {2} AS n FROM p GROUP BY 1, 2 HAVING {2} >= {3})) WHERE rn <= {4} GROUP BY dj)"""


@query(
    "dj_style_profile",
    f"""WITH {SLOTS}, {TRACKS}, {MIXES}, p AS (SELECT dj, mix, track, release AS artist, flag AS genre FROM slots JOIN mixes USING (mix) JOIN tracks USING (track)),
 b AS (SELECT dj, count(DISTINCT mix) AS n_sets, count(track) AS n_tracks, count(DISTINCT track) AS n_unique FROM p GROUP BY dj)"""
    + TOPS.format("genres", "genre", "count(DISTINCT mix)", 1, 5)
    + TOPS.format("artists", "artist", "count(*)", 1, 12)
    + TOPS.format("favourites", "track", "count(*)", 2, 12)
    + " SELECT b.*, round(n_tracks / n_sets, 1) AS avg_tracks, genres, artists, favourites FROM b LEFT JOIN genres USING (dj) LEFT JOIN artists USING (dj) LEFT JOIN favourites USING (dj) WHERE n_sets >= 2",
)
def _(t):
    d = t.plays.join(t.mixes, "mix").join(t.tracks, "track").select("dj", "mix", "track", c("release").alias("artist"), c("flag").alias("genre"))
    return op.performer_profiles(d)


GIGS = """gigs AS (SELECT l_suppkey AS venue, o_custkey AS artist, l_returnflag AS country, l_linestatus AS city, CAST(year(l_shipdate) AS INTEGER) AS year FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""


def gigs(t):
    d = t.plays.join(t.mixes, "mix")
    return d.select("venue", c("dj").alias("artist"), c("flag").alias("country"), c("status").alias("city"), F.year("shipped").alias("year"))


@query(
    "venue_profile",
    f"""WITH {GIGS}, p AS (SELECT venue, artist, count(*) AS n, min(year) AS y0, max(year) AS y1 FROM gigs WHERE venue <> 13 GROUP BY 1, 2),
 k AS (SELECT venue, arg_max(country, (n, -ascii(country))) AS country FROM (SELECT venue, country, count(*) AS n FROM gigs GROUP BY 1, 2) GROUP BY 1),
 y AS (SELECT venue, arg_max(city, (n, -ascii(city))) AS city FROM (SELECT venue, city, count(*) AS n FROM gigs GROUP BY 1, 2) GROUP BY 1)
 SELECT venue, CAST(sum(n) AS BIGINT) AS gigs, count(*) AS artists, count(*) FILTER (n >= 2) AS returning, min(y0) AS first_year, max(y1) AS last_year,
 round(sum(n) / count(*), 2) AS per_artist, round(count(*) FILTER (n >= 2) * 100.0::DOUBLE / count(*), 1) AS returning_pct, any_value(country) AS country, any_value(city) AS city
 FROM p JOIN k USING (venue) JOIN y USING (venue) GROUP BY venue""",
)
def _(t):
    return op.venue_profile(gigs(t), ["13", "tba"])


@query(
    "residency_pairs",
    f"WITH {GIGS} SELECT artist, venue, count(*) AS n, min(year) AS first_year, max(year) AS last_year, count(DISTINCT year) AS years FROM gigs GROUP BY 1, 2 HAVING count(*) >= 2",
)
def _(t):
    return op.residency_pairs(gigs(t))


@query(
    "artist_mobility",
    f"""WITH {GIGS}, p AS (SELECT artist, venue, count(*) AS n FROM gigs GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY artist ORDER BY n DESC, venue) AS rn FROM p)
 SELECT artist, CAST(sum(n) AS BIGINT) AS gigs, count(*) AS venues, max(CASE WHEN rn = 1 THEN venue END) AS top_venue,
 round(max(CASE WHEN rn = 1 THEN n END) * 100.0::DOUBLE / sum(n), 1) AS top_pct, count(*) FILTER (n >= 2) AS repeat_hosts FROM r GROUP BY artist""",
)
def _(t):
    return op.artist_mobility(gigs(t))


@query(
    "multi_label_markers",
    f"""WITH d AS (SELECT text FROM documents), h AS (SELECT 'the' AS label FROM d WHERE {sql_whole_word("text", "the")} UNION ALL SELECT 'les' FROM d WHERE {sql_whole_word("text", "les")}
 UNION ALL SELECT 'number' FROM d WHERE regexp_matches(text, '[0-9]+')) SELECT label, count(*) AS n FROM h GROUP BY label""",
)
def _(t):
    labels = {"the": text.whole_word("the"), "les": text.whole_word("les"), "number": "[0-9]+"}
    return op.multi_label_hits(t.documents, "text", labels).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "canonical_tracks",
    f"""WITH g AS (SELECT 'p' || l_partkey AS key, l_orderkey, l_suppkey, CAST(year(l_shipdate) AS VARCHAR) AS y, l_returnflag, l_linenumber, l_extendedprice, l_linestatus FROM lineitem),
 a AS (SELECT key, count(*) AS occurrences, count(DISTINCT l_suppkey) AS players, string_agg(DISTINCT y, ',' ORDER BY y) AS years, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS sources FROM g GROUP BY key)
 SELECT *, row_number() OVER (ORDER BY occurrences DESC, key) AS item_id FROM a""",
)
def _(t):
    d = t.plays.withColumn("y", F.year("shipped").cast("string")).withColumn("order", F.struct("mix", "line", "price"))
    return op.canonical_items(d, F.concat(F.lit("p"), c("track")), "venue", "y", "flag", "status", "order").drop("label")


@query(
    "entity_resolution",
    """WITH s AS (SELECT p_name AS name, 1 AS pr FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT upper(replace(p_name, ' ', '-')), 2 FROM part UNION ALL SELECT c_mktsegment, 3 FROM customer),
 k AS (SELECT *, regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') AS key FROM s), e AS (SELECT key, arg_min(name, (pr, name)) AS spelling, count(DISTINCT pr) AS n_sources FROM k GROUP BY key)
 SELECT *, row_number() OVER (ORDER BY key) AS entity_id FROM e""",
)
def _(t):
    return op.resolve_entities(entity_names(t), "name", "pr")[0]


def entity_names(t):
    part = t.raw("part")
    a = part.filter(c("p_partkey") % 2 == 0).select(c("p_name").alias("name"), F.lit(1).alias("pr"))
    b = part.select(F.upper(F.replace("p_name", F.lit(" "), F.lit("-"))).alias("name"), F.lit(2).alias("pr"))
    d = t.raw("customer").select(c("c_mktsegment").alias("name"), F.lit(3).alias("pr"))
    return a.unionByName(b).unionByName(d)


@query(
    "entity_aliases",
    """WITH s AS (SELECT p_name AS name, 1 AS pr FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT upper(replace(p_name, ' ', '-')), 2 FROM part UNION ALL SELECT c_mktsegment, 3 FROM customer),
 k AS (SELECT *, regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') AS key FROM s), e AS (SELECT key, arg_min(name, (pr, name)) AS spelling FROM k GROUP BY key),
 n AS (SELECT *, row_number() OVER (ORDER BY key) AS entity_id FROM e) SELECT DISTINCT entity_id, name AS alias FROM k JOIN n USING (key) WHERE name <> spelling""",
)
def _(t):
    return op.resolve_entities(entity_names(t), "name", "pr")[1]


def stats_sql(x: str, n: str) -> str:
    return (
        f"round(avg({x}), 6) AS {n}_mean, round(stddev_pop({x}), 6) + 0.0 AS {n}_std, round(1.0::DOUBLE - count({x})/count(*), 6) + 0.0 AS {n}_missing, "
        f"round(quantile_cont({x}, 0.1), 6) AS {n}_p10, round(quantile_cont({x}, 0.9), 6) AS {n}_p90"
    )


@query(
    "frame_summary_vector",
    f"""WITH {FRAMES}, d AS (SELECT track, value, CASE WHEN event_id % 9 <> 0 THEN ln(1.0::DOUBLE + k) END AS k FROM frames) SELECT track, {stats_sql("value", "value")}, {stats_sql("k", "k")} FROM d GROUP BY track""",
)
def _(t):
    d = t.frames.withColumn("k", F.when(c("event_id") % 9 != 0, c("k")))
    out = op.frame_summary(d, "track", {"value": False, "k": True}, ["value"])
    return out.select("track", *[rounded(c(x)).alias(x) for x in out.columns if x != "track"])


@query(
    "segment_fractions",
    f"""WITH {FRAMES}, s AS (SELECT track, label AS kind, value AS len FROM frames) SELECT track, round(ln(1.0::DOUBLE + count(*)), 6) AS log_count,
 round(sum(CASE WHEN kind = 'click' THEN len ELSE 0 END) / sum(len), 6) AS click, round(sum(CASE WHEN kind = 'view' THEN len ELSE 0 END) / sum(len), 6) AS view FROM s GROUP BY track""",
)
def _(t):
    d = t.frames.select("track", c("label").alias("kind"), F.lit(0.0).alias("start"), c("value").alias("end"))
    out = op.segment_fractions(d, "track", ["click", "view"])
    return out.select("track", *[rounded(c(x)).alias(x) for x in ("log_count", "click", "view")])


@query(
    "track_consensus_tempo",
    "SELECT l_partkey AS track, round(median(l_quantity + 90), 6) AS bpm FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1",
)
def _(t):
    d = t.plays.withColumn("reading", c("qty") + 90)
    return op.consensus(d, "track", "reading", c("flag") != "R", "bpm").withColumn("bpm", rounded(c("bpm")))


VEC = "vecs AS (SELECT vec_id AS track, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"
COS = "list_dot_product({0}, {1}) / sqrt(list_dot_product({0}, {0}) * list_dot_product({1}, {1}))"


def signature_pairs(t):
    """Pairs of a DJ; the facts of a track travel with its vector, so each end is looked up once."""
    d = slot_pairs(t).join(t.mixes.select("mix", "dj"), "mix").select("dj", "a", "b")
    facts = t.tracks.select("track", "bpm", "key").join(t.vectors.select(c("id").alias("track"), "vec"), "track", "left")
    for s in ("a", "b"):
        d = d.join(facts.select(c("track").alias(s), c("bpm").alias(f"bpm_{s}"), c("key").alias(f"key_{s}"), c("vec").alias(f"v{s}")), s)
    return d.select(
        "dj",
        (1 - vectors.cosine(c("va"), c("vb"))).alias("distance"),
        (F.abs(c("bpm_b") - c("bpm_a")) / c("bpm_a") * 100).alias("jump"),
        harmony.relation(c("key_a"), c("key_b")).alias("relation"),
    )


@query(
    "dj_transition_signature",
    f"""WITH {SLOTS}, {TRACKS}, {MIXES}, {PAIRS}, {VEC}, s AS (SELECT dj, 1 - {COS.format("va.v", "vb.v")} AS distance, abs(y.bpm - x.bpm)/x.bpm*100 AS jump,
 {sql_relation("x.num", "x.mode", "y.num", "y.mode")} IN ('exact', 'relative_major_minor', 'adjacent_same_mode') AS safe
 FROM pairs JOIN mixes USING (mix) JOIN tracks x ON x.track = a JOIN tracks y ON y.track = b LEFT JOIN vecs va ON va.track = a LEFT JOIN vecs vb ON vb.track = b),
 g AS (SELECT dj, count(distance) AS n, count(jump) AS nj, avg(distance) AS sound, stddev_pop(distance) AS sound_std, avg(jump) AS tempo, stddev_pop(jump) AS tempo_std, avg(safe::INT::DOUBLE) AS safe FROM s GROUP BY dj)
 SELECT dj, n, round(sound, 6) AS sound, round(sound_std, 6) AS sound_std, round(tempo, 6) AS tempo, round(tempo_std, 6) AS tempo_std, round(safe, 6) + 0.0 AS safe,
 round((rank() OVER (ORDER BY round(sound, 9)) - 1)::DOUBLE / count(*) OVER (), 6) + 0.0 AS below FROM g WHERE n >= 2 AND nj >= 2""",
)
def _(t):
    out = op.transition_signature(signature_pairs(t), "dj", 2)
    return out.select("dj", "n", *[rounded(c(x)).alias(x) for x in ("sound", "sound_std", "tempo", "tempo_std", "safe", "below")])


GAP = """(CASE WHEN nb/bpm > 1.5 THEN abs(nb/bpm/2 - 1) WHEN nb/bpm < 0.67 THEN abs(nb/bpm*2 - 1) ELSE abs(nb/bpm - 1) END)"""


@query(
    "mix_signature",
    f"""WITH {SLOTS}, {TRACKS}, {MIXES}, vecs AS (SELECT vec_id AS vid, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings),
 d AS (SELECT dj, mix * 100 + position AS o, bpm, v FROM slots JOIN mixes USING (mix) JOIN tracks USING (track) JOIN vecs ON vid = track % (SELECT count(*) FROM embeddings)),
 n AS (SELECT *, lead(bpm) OVER w AS nb, lead(v) OVER w AS nv FROM d WINDOW w AS (PARTITION BY dj ORDER BY o)), f AS (SELECT *, {GAP} * nb AS jump, list_dot_product(v, nv) AS cs FROM n),
 q AS (SELECT dj, sum(s*s) AS sq FROM (SELECT dj, i, sum(v[i]) AS s FROM d, range(1, 65) r(i) GROUP BY 1, 2) GROUP BY dj)
 SELECT dj, round(median(bpm), 6) AS bpm_median, round(median(jump), 6) + 0.0 AS jump_median, round(avg((jump < 1)::INT::DOUBLE), 6) + 0.0 AS locked, round(median(cs), 6) + 0.0 AS cos_median,
 round(quantile_cont(cs, 0.75) - quantile_cont(cs, 0.25), 6) + 0.0 AS cos_iqr, round((any_value(sq) - count(*)) / (count(*) * (count(*) - 1)), 6) + 0.0 AS palette,
 round((arg_max(bpm, o) - arg_min(bpm, o)) / (count(*) - 1), 6) + 0.0 AS drift, count(*) AS n FROM f JOIN q USING (dj) GROUP BY dj HAVING count(*) >= 6 AND count(jump) >= 4""",
)
def _(t):
    d = t.slots().join(t.mixes.select("mix", "dj"), "mix").join(t.tracks.select("track", "bpm"), "track")
    d = d.withColumn("o", c("mix") * 100 + c("position")).withColumn("id", t.vector_of("track"))
    out = op.mix_signature(d.select("dj", "o", "bpm", "id"), t.vectors.select("id", "vec"), "dj", "o", [F.floor(c("o") / 100000)])
    keep = ("bpm_median", "jump_median", "locked", "cos_median", "cos_iqr", "palette", "drift")
    return out.select("dj", "n", *[rounded(c(x)).alias(x) for x in keep])


@query(
    "dj_profile_from_facts",
    f"""WITH {SLOTS}, {TRACKS}, {MIXES}, {PAIRS}, s AS (SELECT dj, {sql_relation("x.num", "x.mode", "y.num", "y.mode")} <> 'risky' AS fit, abs(y.bpm - x.bpm)/x.bpm*100 AS jump
 FROM pairs JOIN mixes USING (mix) JOIN tracks x ON x.track = a JOIN tracks y ON y.track = b),
 f AS (SELECT dj, round(avg(fit::INT::DOUBLE)*100, 1) AS fit_pct, count(jump) AS full_, median(jump) AS jm FROM s GROUP BY dj),
 u AS (SELECT DISTINCT dj, track, bpm, energy FROM slots JOIN mixes USING (mix) JOIN tracks USING (track)), l AS (SELECT dj, list_sort(list(bpm)) AS b, median(energy) AS em FROM u GROUP BY dj)
 SELECT dj, fit_pct, full_ AS "full", b[floor(0.1*len(b))::INT + 1] AS bpm_p10, b[floor(0.5*len(b))::INT + 1] AS bpm_mid, b[floor(0.9*len(b))::INT + 1] AS bpm_p90,
 CASE WHEN full_ >= 10 THEN round(jm, 6) END AS jump_median, CASE WHEN full_ >= 10 THEN round(em, 6) END AS energy_median FROM f JOIN l USING (dj)""",
)
def _(t):
    who = t.mixes.select("mix", "dj")
    d = with_track_features(slot_pairs(t), t.tracks, ["bpm", "key"]).join(who, "mix")
    seams = d.select(
        "dj", (harmony.relation(c("key_a"), c("key_b")) != "risky").alias("fit"), (F.abs(c("bpm_b") - c("bpm_a")) / c("bpm_a") * 100).alias("jump")
    )
    owned = t.plays.join(who, "mix").join(t.tracks, "track").select("dj", "track", "bpm", "energy")
    out = op.performer_facts(seams, owned, "dj", 10)
    return out.withColumn("jump_median", rounded(c("jump_median"))).withColumn("energy_median", rounded(c("energy_median")))


@query(
    "seam_profile",
    """WITH s AS (SELECT CASE WHEN l_discount > 0.02 THEN l_quantity END AS len, CASE l_returnflag WHEN 'A' THEN 'hand' WHEN 'N' THEN 'record' ELSE 'unsure' END AS st FROM lineitem)
 SELECT count(*) AS n, count(len) AS n_length, round(avg((st = 'hand')::INT::DOUBLE)*100, 1) AS hand_pct, round(avg((st = 'record')::INT::DOUBLE)*100, 1) AS record_pct, round(avg((st = 'unsure')::INT::DOUBLE)*100, 1) AS unsure_pct,
 quantile_cont(len, 0.25) AS q25, quantile_cont(len, 0.5) AS q50, quantile_cont(len, 0.75) AS q75 FROM s""",
)
def _(t):
    status = F.when(c("flag") == "A", "hand").when(c("flag") == "N", "record").otherwise("unsure")
    d = t.plays.select(F.when(c("discount") > 0.02, c("qty")).alias("len"), status.alias("st"))
    return op.seam_profile(d, "len", "st")


@query(
    "error_metrics",
    """WITH e AS (SELECT abs(l_tax*100 - l_discount*30) AS e FROM lineitem) SELECT count(e) AS n, round(avg(e), 6) AS mean, round(max(e), 6) AS max, round(median(e), 6) AS median, round(quantile_cont(e, 0.9), 6) AS p90,
 count(*) FILTER (e <= 0.1) AS within_0_1, count(*) FILTER (e <= 1) AS within_1_0, count(*) FILTER (e <= 2) AS within_2_0, count(*) FILTER (e > 2) AS gross FROM e""",
)
def _(t):
    d = op.error_metrics(t.plays.select(F.abs(c("tax") * 100 - c("discount") * 30).alias("e")), "e")
    return d.select("n", *[rounded(c(x)).alias(x) for x in ("mean", "max", "median", "p90")], "within_0_1", "within_1_0", "within_2_0", "gross")


@query(
    "keyword_topic_counts",
    """WITH h AS (SELECT 'english' AS topic FROM conversations WHERE lower(text) LIKE '%the%' OR lower(text) LIKE '%and%' UNION ALL SELECT 'french' FROM conversations WHERE lower(text) LIKE '%les%' OR lower(text) LIKE '%eau%')
 SELECT topic, count(*) AS n FROM h GROUP BY topic""",
)
def _(t):
    return op.topic_counts(t.raw("conversations"), "text", {"english": ["the", "and"], "french": ["les", "eau"]})


@query(
    "catalog_summary",
    f"""WITH {SLOTS}, {MIXES}, {PAIRS} SELECT (SELECT count(*) FROM slots) AS slots, (SELECT count(DISTINCT track) FROM slots) AS tracks, (SELECT count(*) FROM slots WHERE track % 100 = 0) AS placeholders,
 (SELECT count(*) FROM pairs) AS adjacencies, (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS issues, count(*) AS mixes, count(DISTINCT dj) AS performers,
 strftime(min(day), '%Y-%m-%d') AS first_day, strftime(max(day), '%Y-%m-%d') AS last_day FROM mixes""",
)
def _(t):
    issues = t.mixes.join(t.plays.select("mix"), "mix", "left_anti")
    s = t.plays.withColumn("placeholder", c("track") % 100 == 0)
    return op.catalog_summary(s, t.mixes, slot_pairs(t), issues)


@query(
    "verdict_counts",
    "SELECT count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'longer') AS longer FROM events",
)
def _(t):
    return op.verdict_counts(t.frames, "label", ["click", "view", "longer"])


@query(
    "quantiles_by_group",
    f"""WITH {TRACKS} SELECT style, round(quantile_cont(energy, 0.25), 8) AS q1, round(median(energy), 8) AS q2, round(quantile_cont(energy, 0.75), 8) AS q3,
 list_sort(list(energy))[count(*) // 2 + 1] AS index_median, round(avg((bpm BETWEEN 100 AND 120)::INT::DOUBLE), 6) + 0.0 AS band_share FROM tracks GROUP BY style""",
)
def _(t):
    from seguelake import grouping

    q = grouping.quantiles(t.tracks, ["style"], "energy", {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    i = op.order_statistics(t.tracks, ["style"], "energy", {"index_median": 0.5})
    band = t.tracks.groupBy("style").agg(rounded(F.avg(c("bpm").between(100, 120).cast("double"))).alias("band_share"))
    return q.join(i, "style").join(band, "style").select("style", *[rounded(c(x), 8).alias(x) for x in ("q1", "q2", "q3")], "index_median", "band_share")
