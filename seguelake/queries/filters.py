"""Queries on filters and predicates."""

from pyspark.sql import functions as F

from seguelake.bindings import FRAMES, MIXES, SLOTS, TRACKS, sql_fold, sql_whole_word
from seguelake.functions import tempo, text
from seguelake.functions.numeric import rounded
from seguelake.operators import filters as op
from seguelake.queries import query

c = F.col


@query("filter_library", f"WITH {TRACKS} SELECT track, bpm, style FROM tracks WHERE lower(title || ' ' || style) LIKE '%ring%' AND camelot = '8A' AND bpm BETWEEN 100 AND 135")
def _(t):
    return op.filter_library(t.tracks, "RING", "8A", 100, 135).select("track", "bpm", "style")


@query(
    "style_matches",
    f"""WITH {TRACKS}, n AS (SELECT track, lower(style) AS label, CAST(substr(style, 7) AS INTEGER) AS k FROM tracks)
 SELECT track, CASE WHEN k < 15 THEN 'family-' || (k % 5) ELSE label END AS canon,
 CASE WHEN k < 15 THEN k % 5 IN (1, 2) ELSE k = 20 END AS matches FROM n""",
)
def _(t):
    k = F.substring("style", 7, 9).cast("int")
    taxonomy = t.tracks.select(c("style").alias("alias"), F.concat(F.lit("Family "), k % 5).alias("canon")).filter(k < 15).distinct()
    d = op.style_matches(t.tracks, taxonomy, ["family-1", "family-2", "brand#20"])
    return d.select("track", "canon", "matches")


@query("bpm_in_range", f"WITH {TRACKS} SELECT track, CASE WHEN track % 11 = 0 THEN false ELSE bpm BETWEEN 95 AND 120 END AS inside FROM tracks")
def _(t):
    bpm = F.when(c("track") % 11 != 0, c("bpm"))
    return t.tracks.select("track", tempo.in_range(bpm, F.lit(95), F.lit(120)).alias("inside"))


@query(
    "quality_core_filter",
    f"""WITH {SLOTS}, {MIXES}, n AS (SELECT mix, count(track) AS n_tracks FROM slots GROUP BY mix)
 SELECT mix, n_tracks, CASE WHEN lower(priority) LIKE '%urgent%' THEN 'bass' WHEN lower(priority) LIKE '%high%' THEN 'trance'
 WHEN lower(priority) LIKE '%low%' THEN 'techno' ELSE 'other' END AS family FROM mixes JOIN n USING (mix) WHERE n_tracks >= 5""",
)
def _(t):
    families = {"bass": "urgent", "trance": "high", "techno": "low"}
    return op.quality_core(t.mixes, t.plays, families, "priority", 5).select("mix", "n_tracks", "family")


QUALIFIED = """(SELECT l_orderkey AS mix, CASE WHEN l_partkey % 50 = 0 THEN 'missing_track_identity' WHEN l_suppkey % 20 = 0 THEN 'missing_alignment'
 WHEN l_returnflag = 'R' THEN 'not_matched' WHEN l_tax = 0.08 THEN 'invalid_match_rate' WHEN l_discount * 10 < 0.3 THEN 'low_match_rate'
 WHEN l_quantity = 7 THEN 'invalid_alignment_cost' WHEN l_linestatus = 'F' THEN 'unreliable_beatgrid' ELSE 'accepted' END AS reason FROM lineitem)"""


def with_alignment(d):
    """Line items read as alignment results."""
    return d.select(
        "*",
        F.when(c("track") % 50 != 0, c("track")).alias("identity"),
        (c("venue") % 20 != 0).alias("aligned"),
        (c("flag") != "R").alias("matched"),
        F.when(c("tax") != 0.08, c("discount") * 10).alias("match_rate"),
        F.when(c("qty") != 7, c("price")).alias("cost"),
        (c("status") != "F").alias("reliable"),
    )


@query("qualify_with_reason", f"SELECT reason, count(*) AS n FROM {QUALIFIED} GROUP BY reason")
def _(t):
    d = with_alignment(t.plays).withColumn("reason", op.qualify_reason(0.3))
    return d.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "filter_funnel",
    """WITH s AS (SELECT *, l_returnflag <> 'R' AS a, l_returnflag <> 'R' AND l_discount >= 0.03 AS b,
 l_returnflag <> 'R' AND l_discount >= 0.03 AND l_quantity > 25 AS c FROM lineitem),
 l AS (SELECT 'all' AS step, l_orderkey, l_partkey FROM s UNION ALL SELECT 'matched', l_orderkey, l_partkey FROM s WHERE a
 UNION ALL SELECT 'rated', l_orderkey, l_partkey FROM s WHERE b UNION ALL SELECT 'long', l_orderkey, l_partkey FROM s WHERE c)
 SELECT step, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM lineitem), 1) AS pct, count(DISTINCT l_partkey) AS tracks,
 count(DISTINCT l_orderkey) AS sessions FROM l GROUP BY step""",
)
def _(t):
    steps = [("matched", c("flag") != "R"), ("rated", c("discount") >= 0.03), ("long", c("qty") > 25)]
    return op.filter_funnel(t.plays, steps, {"tracks": c("track"), "sessions": c("mix")})


@query("non_music_filter", r"SELECT page_id, url FROM pages WHERE NOT regexp_matches(lower(url), '(?:/25)|(?:ref=)|(?:^https://m\.)')")
def _(t):
    return op.non_music(t.raw("pages"), "url", ["/25", "ref=", r"^https://m\."]).select("page_id", "url")


@query(
    "event_membership",
    f"""WITH d AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, text FROM documents) SELECT doc_id,
 CASE WHEN {sql_whole_word("title", "the")} THEN 'alpha' WHEN {sql_whole_word("title || ' ' || text", "des")} THEN 'beta' ELSE 'gamma' END AS event
 FROM d WHERE NOT regexp_matches(title, '(?i)license|copyright') AND ({sql_whole_word("title", "the")}
 OR {sql_whole_word("title || ' ' || text", "des")} OR {sql_whole_word("title || ' ' || text", "und")})""",
)
def _(t):
    d = t.documents.select("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), "text")
    rules = [("alpha", text.whole_word("the"), True), ("beta", text.whole_word("des"), False), ("gamma", text.whole_word("und"), False)]
    return op.event_membership(d, "title", "text", rules, "(?iu)license|copyright").select("doc_id", "event")


BANDS = f"""WITH {SLOTS}, {TRACKS}, req AS (SELECT mix AS req, bpm AS previous, bpm * 1.02 AS target FROM slots JOIN tracks USING (track) WHERE position = 1),
 pool AS (SELECT s.mix AS req, s.position, s.track, t.bpm, r.target, r.previous, CASE WHEN abs(r.target-t.bpm) <= abs(r.target-2*t.bpm)
 AND abs(r.target-t.bpm) <= abs(r.target-0.5*t.bpm) THEN t.bpm WHEN abs(r.target-2*t.bpm) <= abs(r.target-0.5*t.bpm) THEN 2*t.bpm ELSE 0.5*t.bpm END AS v
 FROM slots s JOIN tracks t USING (track) JOIN req r ON r.req = s.mix WHERE s.position > 1)"""


@query(
    "tempo_band_filter",
    f"""{BANDS}, tier AS (SELECT *, CASE WHEN v < previous - 0.5 THEN NULL WHEN abs(v-target) <= target*1.0/100.0::DOUBLE THEN 1.0 WHEN abs(v-target) <= target*2.0/100.0::DOUBLE THEN 2.0
 WHEN abs(v-target) <= target*4.0/100.0::DOUBLE THEN 4.0 WHEN abs(v-target) <= target*6.0/100.0::DOUBLE THEN 6.0 END::DOUBLE AS tier FROM pool),
 b AS (SELECT *, min(tier) OVER (PARTITION BY req) AS band FROM tier) SELECT req, position, track, band FROM b WHERE band IS NULL OR tier = band""",
)
def _(t):
    d = t.slots().join(t.tracks.select("track", "bpm"), "track").withColumnRenamed("mix", "req")
    req = d.filter(c("position") == 1).select("req", c("bpm").alias("previous"), (c("bpm") * 1.02).alias("target"))
    return op.tempo_band(d.filter(c("position") > 1).join(req, "req"), "req").select("req", "position", "track", "band")


@query(
    "sound_sieve",
    """WITH m AS (SELECT i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) r(i) GROUP BY i), a AS (SELECT embedding AS av FROM embeddings WHERE vec_id = 3),
 x AS (SELECT vec_id, sum((embedding[i]::DOUBLE - m) * (av[i]::DOUBLE - m)) / sqrt(sum(power(embedding[i]::DOUBLE - m, 2)) * sum(power(av[i]::DOUBLE - m, 2))) AS cs
 FROM embeddings, a, m GROUP BY vec_id), r AS (SELECT *, row_number() OVER (ORDER BY cs DESC, vec_id) AS rn, count(*) OVER () AS n FROM x)
 SELECT vec_id AS id, round(cs, 6) + 0.0 AS closeness FROM r WHERE rn <= round(n * 0.2) OR vec_id % 97 = 0""",
)
def _(t):
    anchor = t.vectors.filter(c("id") == 3).select("vec")
    d = op.sound_sieve(t.vectors, anchor, c("id") % 97 == 0, 20)
    return d.select("id", rounded(c("closeness")).alias("closeness"))


@query(
    "placeholder_title",
    r"""WITH d AS (SELECT doc_id, lang, source, CASE doc_id % 4 WHEN 0 THEN 'ID' WHEN 1 THEN '-- ?' WHEN 2 THEN 'Unreleased ID' ELSE text END AS title FROM documents),
 k AS (SELECT *, regexp_replace(lower(strip_accents(title)), '[^a-z0-9]+', ' ', 'g') AS w FROM d)
 SELECT doc_id, len(list_filter(string_split(trim(w), ' '), lambda x: x <> '' AND x NOT IN ('id', 'unreleased', 'unknown', 'untitled', 'track'))) = 0 AS placeholder,
 CASE WHEN len(list_filter(string_split(trim(w), ' '), lambda x: x <> '' AND x NOT IN ('id', 'unreleased', 'unknown', 'untitled', 'track'))) = 0
 THEN 'row:' || lang || ':' || doc_id ELSE source || '|' || regexp_replace(w, '[^a-z0-9]+', '', 'g') END AS identity FROM k""",
)
def _(t):
    title = (
        F.when(c("doc_id") % 4 == 0, "ID").when(c("doc_id") % 4 == 1, "-- ?").when(c("doc_id") % 4 == 2, "Unreleased ID")
        .otherwise(c("text"))
    )
    d = t.documents.withColumn("title", title)
    return d.select(
        "doc_id",
        text.is_placeholder(c("title")).alias("placeholder"),
        op.row_identity(c("source"), c("title"), c("lang"), c("doc_id")).alias("identity"),
    )


@query(
    "three_valued_presence",
    """SELECT l_suppkey AS artist, CASE WHEN bool_or(l_returnflag = 'A' AND l_linestatus = 'O' AND l_quantity > 49) THEN 'seen' WHEN bool_or(l_returnflag = 'A' AND l_quantity > 47)
 THEN 'never_in_slot' ELSE 'not_described' END AS state, count(*) AS n, count(*) FILTER (l_returnflag = 'A' AND l_quantity > 47) AS n_described
 FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-06-01' GROUP BY l_suppkey""",
)
def _(t):
    told = (c("flag") == "A") & (c("qty") > 47)
    d = t.plays.withColumnRenamed("venue", "artist")
    seen = (c("flag") == "A") & (c("status") == "O") & (c("qty") > 49)
    return op.three_valued_presence(d, "artist", told, seen, F.to_date("shipped") >= "2001-06-01")


@query(
    "sentinel_timestamp_filter",
    f"""WITH {FRAMES}, d AS (SELECT track, max(t) * 0.9 AS duration FROM frames GROUP BY track)
 SELECT event_id FROM frames JOIN d USING (track) WHERE t <= duration * 1.02::DOUBLE AND regexp_matches(label, '^(click|view)$')""",
)
def _(t):
    comments = t.frames.withColumn("text", c("label"))
    durations = t.frames.groupBy("track").agg((F.max("t") * 0.9).alias("duration"))
    return op.sentinel_comments(comments, durations, "track", "^(click|view)$").select("event_id")


@query(
    "suspicious_file_predicate",
    """SELECT doc_id, CASE WHEN regexp_matches(lower(source || '/' || lang), '/de$') THEN 'stem_file' WHEN regexp_matches(lower(source || '/' || lang), '^src1/')
 THEN 'recording_folder' WHEN n_chars < 200 THEN 'too_short' ELSE 'too_long' END AS reason FROM documents
 WHERE regexp_matches(lower(source || '/' || lang), '/de$') OR regexp_matches(lower(source || '/' || lang), '^src1/') OR n_chars < 200 OR n_chars > 5000""",
)
def _(t):
    d = t.documents.withColumn("path", F.concat_ws("/", "source", "lang"))
    return op.suspicious_files(d, "path", "n_chars", 200, 5000, "/de$", "^src1/").select("doc_id", "reason")
