"""Queries on joins and record linkage."""

from pyspark.sql import functions as F

from seguelake.bindings import FRAMES, MIXES, PAIRS, SLOTS, TRACKS, sql_fold
from seguelake.functions import tempo
from seguelake.functions.numeric import rounded
from seguelake.operators import histories
from seguelake.operators import joins as op
from seguelake.operators.filters import qualify_reason
from seguelake.queries import query
from seguelake.queries.filters import with_alignment
from seguelake.queries.pairs import MIX, COMP, scored_pairs, slot_pairs

c = F.col


@query(
    "attach_embeddings",
    """SELECT p_partkey AS track, CASE WHEN p_partkey % 10 = 0 THEN 'kept' WHEN vec_id IS NOT NULL THEN 'attached' ELSE 'missing' END AS origin,
 CASE WHEN p_partkey % 10 = 0 THEN 0.5 ELSE round(embedding[1]::DOUBLE, 6) END AS first FROM part LEFT JOIN embeddings ON vec_id = p_partkey""",
)
def _(t):
    tracks = t.tracks.select(
        "track",
        F.concat(F.lit("Música/Track "), c("track"), F.lit(".wav")).alias("path"),
        F.when(c("track") % 10 == 0, F.array(F.lit(0.5))).alias("vec"),
    )
    vecs = t.vectors.select(F.concat(F.lit("MUSICA/track "), c("id"), F.lit(".WAV")).alias("path"), "vec")
    d = op.attach_vectors(tracks, vecs, "path", "vec")
    return d.select("track", "origin", rounded(F.get("vec", F.lit(0))).alias("first"))


@query(
    "enrich_missing_fields",
    """SELECT p_partkey AS track, CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN p_partkey % 4 <> 0 THEN p_brand END ELSE p_brand END AS style,
 CASE WHEN p_partkey % 5 = 0 THEN CASE WHEN p_partkey % 4 <> 0 AND p_partkey % 2 = 1 THEN p_type END ELSE p_type END AS camelot, p_partkey % 4 <> 0 AS found FROM part""",
)
def _(t):
    tracks = t.tracks.select(
        "track",
        F.when(c("track") % 3 != 0, c("style")).alias("style"),
        F.when(c("track") % 5 != 0, c("release")).alias("camelot"),
        (c("track") % 2 == 0).alias("manual"),
    )
    lookup = t.tracks.filter(c("track") % 4 != 0).select("track", "style", c("release").alias("camelot"))
    return op.enrich_missing(tracks, lookup, "track", ["style", "camelot"], {"camelot": c("manual")}).drop("manual")


@query(
    "exact_then_unique_fallback",
    """WITH l AS (SELECT p_partkey AS id, p_name || '/' || p_size AS path, p_name || p_brand AS name FROM part),
 r AS (SELECT p_partkey AS rid, p_name || '/' || (p_size + p_partkey % 2 * 100) AS path, p_name || p_brand AS name FROM part),
 e AS (SELECT path, max(rid) AS e FROM r GROUP BY path), u AS (SELECT name, min(rid) AS u FROM r GROUP BY name HAVING count(DISTINCT rid) = 1)
 SELECT id, CASE WHEN e IS NOT NULL THEN 'exact' WHEN u IS NOT NULL THEN 'unique_fallback' ELSE 'unmatched' END AS method, coalesce(e, u) AS match
 FROM l LEFT JOIN e USING (path) LEFT JOIN u USING (name)""",
)
def _(t):
    part = t.raw("part")
    name = F.concat("p_name", "p_brand").alias("name")
    left = part.select(c("p_partkey").alias("id"), F.concat_ws("/", "p_name", "p_size").alias("path"), name)
    size = c("p_size") + c("p_partkey") % 2 * 100
    right = part.select(c("p_partkey").alias("rid"), F.concat_ws("/", "p_name", size).alias("path"), name)
    return op.exact_then_unique(left, right, "path", "name", "rid").select("id", "method", "match")


@query(
    "link_with_confidence",
    r"""WITH u AS (SELECT page_id, url, lower(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '')) AS cu, split_part(url, '/', 4) || (page_id // 4) AS artist, page_id % 3 AS year FROM pages),
 s AS (SELECT page_id AS set_id, CASE WHEN page_id % 8 = 0 THEN cu ELSE 'x' || page_id END AS cu, artist, CAST(year AS VARCHAR) AS year FROM u),
 bu AS (SELECT cu, max(set_id) AS su FROM s GROUP BY cu), bw AS (SELECT artist, year, min(set_id) AS sw FROM s GROUP BY 1, 2 HAVING count(*) = 1)
 SELECT page_id AS list_id, CASE WHEN su IS NOT NULL THEN 'url' WHEN u.artist LIKE '%3' THEN 'rejected' WHEN sw IS NOT NULL THEN 'artist_year' ELSE 'new' END AS tier,
 CASE WHEN su IS NOT NULL THEN su WHEN u.artist LIKE '%3' THEN NULL ELSE sw END AS set_id
 FROM u LEFT JOIN bu USING (cu) LEFT JOIN bw ON bw.artist = u.artist AND bw.year = CAST(u.year AS VARCHAR)""",
)
def _(t):
    pages = t.raw("pages")
    artist = F.concat(F.split_part("url", F.lit("/"), F.lit(4)), F.floor(c("page_id") / 4))
    lists = pages.select(c("page_id").alias("list_id"), "url", artist.alias("artist"), (c("page_id") % 3).cast("string").alias("year"))
    sets = lists.select(
        c("list_id").alias("set_id"),
        F.when(c("list_id") % 8 == 0, F.concat(F.upper(op.clean_url(c("url"))), F.lit("/?utm=1"))).otherwise(F.concat(F.lit("x"), c("list_id"))).alias("url"),
        "artist",
        "year",
    )
    known = lists.filter(~c("artist").endswith("3")).select(F.upper("artist").alias("artist"))
    return op.link_with_confidence(lists, sets, known)


@query(
    "record_linkage",
    """WITH l AS (SELECT list_sort(list_distinct([lower(p_type), 'dj'])) AS a, list_sort(list_distinct(string_split(p_name, ' '))) AS t FROM part WHERE p_partkey % 2 = 0),
 r AS (SELECT list_sort(list_distinct([lower(p_type), 'x' || p_size])) AS a, list_sort(list_distinct(CASE p_partkey % 3 WHEN 0 THEN string_split(p_name, ' ')
 WHEN 1 THEN list_concat(string_split(p_name, ' '), ['chroma', '010']) ELSE list_concat(string_split(p_name, ' '), ['2']) END)) AS t FROM part WHERE p_partkey % 2 = 1),
 la AS (SELECT a, t, count(*) AS n FROM l GROUP BY ALL), ra AS (SELECT a, t, count(*) AS n FROM r GROUP BY ALL)
 SELECT array_to_string(la.a, ' ') AS artist_a, array_to_string(la.t, ' ') AS title_a, array_to_string(ra.a, ' ') AS artist_b, array_to_string(ra.t, ' ') AS title_b,
 la.n AS n_a, ra.n AS n_b, CASE WHEN la.t = ra.t THEN 'same' ELSE 'series' END AS kind
 FROM la JOIN ra ON list_has_any(la.a, ra.a) AND (la.t = ra.t OR (list_has_all(ra.t, la.t) AND list_contains(ra.t, 'chroma')))""",
)
def _(t):
    part = t.raw("part")
    lib = part.filter(c("p_partkey") % 2 == 0).select(F.concat_ws(" ", "p_type", F.lit("DJ")).alias("artist"), c("p_name").alias("title"))
    k = c("p_partkey") % 3
    title = F.when(k == 0, F.concat("p_name", F.lit(" (Original Mix)"))).when(k == 1, F.concat(F.lit("CHROMA 010 "), c("p_name"))).otherwise(
        F.concat_ws(" ", "p_name", F.lit("2"))
    )
    rel = part.filter(c("p_partkey") % 2 == 1).select(F.concat(c("p_type"), F.lit(", X"), c("p_size")).alias("artist"), title.alias("title"))
    d = op.record_linkage(op.record_keys(lib, "artist", "title"), op.record_keys(rel, "artist", "title"))
    words = [F.array_join(x, " ").alias(x) for x in ("artist_a", "title_a", "artist_b", "title_b")]
    return d.select(*words, "n_a", "n_b", "kind")


TOK = r"list_filter(list_distinct(string_split(trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g')), ' ')), lambda x: length(x) > 2)"


@query(
    "fuzzy_containment_match",
    f"""WITH a AS (SELECT conv_id, turn AS nid, {TOK} AS wa FROM conversations WHERE role = 'assistant'), b AS (SELECT conv_id, turn AS pos, {TOK} AS wb FROM conversations WHERE role = 'user'),
 s AS (SELECT a.conv_id, nid, pos, len(list_intersect(wa, wb)) / least(len(wa), len(wb)) AS score FROM a JOIN b USING (conv_id) WHERE len(list_intersect(wa, wb)) > 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, nid ORDER BY score DESC, pos) AS rn FROM s)
 SELECT conv_id, nid, pos, round(score, 6) AS score FROM r WHERE rn = 1 AND score >= 0.2""",
)
def _(t):
    d = t.raw("conversations")
    named = d.filter(c("role") == "assistant").select("conv_id", c("turn").alias("nid"), "text")
    listed = d.filter(c("role") == "user").select("conv_id", c("turn").alias("pos"), "text")
    return op.fuzzy_containment(named, listed, "conv_id", 0.2).withColumn("score", rounded(c("score")))


OCC = """l AS (SELECT l_orderkey AS mix, l_partkey AS track, l_suppkey AS venue, l_extendedprice AS price, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber, l_suppkey, l_extendedprice) AS k FROM lineitem),
 p AS (SELECT *, l_partkey + CASE WHEN l_quantity % 10 = 0 THEN 1 ELSE 0 END AS named FROM lineitem), r AS (SELECT l_orderkey AS mix, named AS track, l_quantity AS qty, row_number() OVER (PARTITION BY l_orderkey, named ORDER BY l_extendedprice, l_suppkey, l_linenumber) AS k FROM p)"""


def occurrences(t):
    slots = t.plays.select("mix", "track", "line", "venue", "price")
    # some reports name another track than the one played
    reports = t.plays.select("mix", (c("track") + F.when(c("qty") % 10 == 0, 1).otherwise(0)).alias("track"), c("price").alias("rp"), c("venue").alias("rv"), c("line").alias("rl"), "qty")
    return op.occurrence_join(slots, reports, ["mix", "track"], ["line", "venue", "price"], ["rp", "rv", "rl"], [c("line")], [F.floor(c("rp"))])


@query("occurrence_join", f"WITH {OCC} SELECT l.mix, l.track, l.k, l.price, r.qty FROM l LEFT JOIN r USING (mix, track, k)")
def _(t):
    return occurrences(t)[0].select("mix", "track", "k", "price", "qty")


@query("occurrence_orphans", f"WITH {OCC} SELECT r.mix, r.track, r.k FROM r ANTI JOIN l USING (mix, track, k)")
def _(t):
    return occurrences(t)[1].select("mix", "track", "k")


WINDOWS = f"""{TRACKS}, win AS (SELECT track, (i*60 + track % 17)::DOUBLE AS start, (i*60 + track % 17 + 16)::DOUBLE AS "end",
 CASE (track + i) % 4 WHEN 0 THEN 'mix_in' WHEN 1 THEN 'mix_out' ELSE 'bridge' END AS kind, round((track*7 + i*31) % 100 / 100.0::DOUBLE, 2) AS score,
 round((track*3 + i*17) % 50 / 100.0::DOUBLE, 2) AS risk FROM tracks, range(0, 3) r(i))"""


def windows_of(t):
    """Three derived transition windows per track."""
    i = c("i")
    d = t.tracks.select("track", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i"))
    start = (i * 60 + c("track") % 17).cast("double")
    k = (c("track") + i) % 4
    return d.select(
        "track",
        start.alias("start"),
        (start + 16).alias("end"),
        F.when(k == 0, "mix_in").when(k == 1, "mix_out").otherwise("bridge").alias("kind"),
        F.round((c("track") * 7 + i * 31) % 100 / 100.0, 2).alias("score"),
        F.round((c("track") * 3 + i * 17) % 50 / 100.0, 2).alias("risk"),
    )


@query(
    "window_pair_join",
    f"""WITH {SLOTS}, {WINDOWS}, {PAIRS}, e AS (SELECT DISTINCT a, b FROM pairs),
 o AS (SELECT * FROM (SELECT *, bool_or(kind = 'mix_out') OVER (PARTITION BY track) AS h FROM win) WHERE NOT h OR kind = 'mix_out'),
 n AS (SELECT * FROM (SELECT *, bool_or(kind = 'mix_in') OVER (PARTITION BY track) AS h FROM win) WHERE NOT h OR kind = 'mix_in'),
 p AS (SELECT a, b, o.start AS start_a, n.start AS start_b, 0.5 + o.score + n.score - 0.65 * ((o.risk + n.risk) / 2) AS ps FROM e JOIN o ON o.track = a JOIN n ON n.track = b),
 r AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY ps DESC, start_a, start_b) AS rank FROM p) SELECT a, b, CAST(rank AS INTEGER) AS rank, round(ps, 6) AS pair_score FROM r WHERE rank <= 3""",
)
def _(t):
    edges = slot_pairs(t).select("a", "b").distinct().withColumn("m", F.lit(0.5))
    d = op.window_pairs(edges, windows_of(t))
    return d.select("a", "b", "rank", rounded(c("pair_score")).alias("pair_score"))


IVALS = f"{FRAMES}, iv AS (SELECT event_id AS iid, track, t + 600 AS start, t + 4200 AS \"end\" FROM frames WHERE label = 'error')"


def intervals_of(t):
    return t.frames.filter(c("label") == "error").select(
        c("event_id").alias("iid"), "track", (c("t") + 600).alias("start"), (c("t") + 4200).alias("end")
    )


@query(
    "frame_interval_join",
    f"""WITH {IVALS}, m AS (SELECT iid, avg(value) AS m, count(value) AS n FROM iv JOIN frames f ON f.track = iv.track AND f.t BETWEEN iv.start AND iv."end" GROUP BY iid),
 z AS (SELECT iv.iid, f.value, row_number() OVER (PARTITION BY iv.iid ORDER BY abs(f.t - (start + "end")/2), f.t) AS rn FROM iv JOIN frames f ON f.track = iv.track WHERE iv.iid NOT IN (SELECT iid FROM m))
 SELECT iv.iid, round(coalesce(m, value), 6) AS mean, coalesce(n, 0) AS n FROM iv LEFT JOIN m USING (iid) LEFT JOIN (SELECT * FROM z WHERE rn = 1) z USING (iid)""",
)
def _(t):
    d = op.interval_mean(t.frames, intervals_of(t), "track", "value", 3600.0)
    return d.select("iid", rounded(c("mean")).alias("mean"), "n")


@query(
    "asof_marker_join",
    f"""WITH {FRAMES}, m AS (SELECT track, t, value FROM frames WHERE label = 'error'), f AS (SELECT track, min(t) AS ft, arg_min(value, t) AS fv FROM m GROUP BY track)
 SELECT e.event_id, coalesce(m.value, f.fv) AS marker, round(coalesce(m.t, f.ft), 6) AS mark_t FROM (SELECT * FROM frames WHERE label <> 'error') e
 ASOF LEFT JOIN m ON m.track = e.track AND m.t <= e.t LEFT JOIN f ON f.track = e.track""",
)
def _(t):
    events = t.frames.filter(c("label") != "error").select("event_id", "track", "t")
    marks = t.frames.filter(c("label") == "error").select("track", "t", "value")
    d = op.asof(events, marks, "track", "t", 3600.0, {"marker": "value"})
    return d.select("event_id", "marker", rounded(c("mark_t")).alias("mark_t"))


@query(
    "section_at",
    f"""WITH {IVALS}, s AS (SELECT track, start, start + 1800 AS "end", CASE iid % 3 WHEN 0 THEN ' Intro' WHEN 1 THEN 'DROP ' ELSE 'break' END AS label FROM iv)
 SELECT event_id, CASE WHEN f.t < s."end" THEN lower(trim(s.label)) END AS section FROM frames f ASOF LEFT JOIN s ON s.track = f.track AND s.start <= f.t""",
)
def _(t):
    k = c("iid") % 3
    label = F.when(k == 0, " Intro").when(k == 1, "DROP ").otherwise("break")
    sections = intervals_of(t).select("track", "start", (c("start") + 1800).alias("end"), label.alias("label"))
    return op.section_at(t.frames.select("event_id", "track", "t"), sections, "track", "t", 3600.0).select("event_id", "section")


NEAR = """near AS (SELECT e.event_id, e.track, e.t, b.t AS bt, a.t AS nt, b.event_id AS bid, a.event_id AS aid FROM e ASOF LEFT JOIN m b ON b.track = e.track AND b.t <= e.t
 ASOF LEFT JOIN m a ON a.track = e.track AND a.t >= e.t), pick AS (SELECT *, nt IS NULL OR coalesce(t - bt <= nt - t, false) AS early FROM near)"""


@query(
    "nearest_event_join",
    f"""WITH {FRAMES}, m AS (SELECT * FROM frames WHERE label = 'error'), e AS (SELECT * FROM frames WHERE label <> 'error'), {NEAR}
 SELECT event_id, CASE WHEN early THEN bid ELSE aid END AS anchor, round(abs(t - CASE WHEN early THEN bt ELSE nt END), 6) + 0.0 AS distance FROM pick""",
)
def _(t):
    events = t.frames.filter(c("label") != "error").select("event_id", "track", "t")
    marks = t.frames.filter(c("label") == "error").select("track", "t", c("event_id").alias("mid"))
    d = op.nearest(events, marks, "track", "t", 3600.0, {"anchor": "mid"})
    return d.select("event_id", "anchor", rounded(c("distance")).alias("distance"))


@query(
    "tolerance_match",
    f"""WITH {FRAMES}, p AS (SELECT event_id AS pid, track, t, k % 8 AS pad FROM frames WHERE label = 'view'), x AS (SELECT event_id AS eid, track, t, k % 8 AS pad FROM frames WHERE label = 'error'),
 d AS (SELECT pid, min(eid) AS dup FROM p JOIN x ON x.track = p.track AND x.t BETWEEN p.t - 2000 AND p.t + 2000 GROUP BY pid), q AS (SELECT track, pad, min(eid) AS on_pad FROM x GROUP BY 1, 2)
 SELECT pid, CASE WHEN dup IS NOT NULL THEN 'deduped' WHEN on_pad IS NOT NULL THEN 'relocated' ELSE 'placed' END AS resolution, coalesce(dup, on_pad) AS existing FROM p LEFT JOIN d USING (pid) LEFT JOIN q USING (track, pad)""",
)
def _(t):
    pad = (c("k") % 8).alias("pad")
    planned = t.frames.filter(c("label") == "view").select(c("event_id").alias("pid"), "track", "t", pad)
    existing = t.frames.filter(c("label") == "error").select(c("event_id").alias("eid"), "track", "t", pad)
    return op.cue_collisions(planned, existing, "track", 2000.0, "merge").select("pid", "resolution", "existing")


WORDS = r"string_split(trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g')), ' ')"


@query(
    "mention_match",
    f"""WITH k AS (SELECT gram, min(text) AS name, len(string_split(gram, ' ')) AS n FROM (SELECT text, array_to_string({WORDS}, ' ') AS gram FROM benchmark) WHERE length(gram) >= 5 GROUP BY 1),
 w AS (SELECT doc_id AS id, ' ' || array_to_string({WORDS}, ' ') || ' ' AS words FROM documents), h AS (SELECT id, arg_max(name, (length(gram), gram)) AS name FROM w JOIN k ON contains(words, ' ' || gram || ' ') GROUP BY id)
 SELECT id, name, row_number() OVER (PARTITION BY name ORDER BY id DESC) AS rank FROM h""",
)
def _(t):
    return op.mentions(t.documents.select(c("doc_id").alias("id"), "text"), t.raw("benchmark").select(c("text").alias("name"))).select("id", "name", "rank")


@query(
    "strict_history_join",
    f"""WITH {SLOTS}, {MIXES}, f AS (SELECT dj, track, min(day) AS first FROM slots JOIN mixes USING (mix) GROUP BY 1, 2), ft AS (SELECT dj, first, count(*) AS n FROM f GROUP BY 1, 2),
 hs AS (SELECT m.mix, count(p.mix) AS prior_sets, count(p.mix) FILTER (m.day - p.day <= 90) AS window_sets FROM mixes m LEFT JOIN mixes p ON p.dj = m.dj AND p.day < m.day GROUP BY m.mix),
 ht AS (SELECT m.mix, CAST(coalesce(sum(n), 0) AS BIGINT) AS prior_tracks FROM mixes m LEFT JOIN ft ON ft.dj = m.dj AND ft.first < m.day GROUP BY m.mix)
 SELECT mix, prior_sets, window_sets, prior_tracks FROM hs JOIN ht USING (mix)""",
)
def _(t):
    return op.strict_history(t.mixes, t.plays.select("mix", "track"), 90).select("mix", "prior_sets", "window_sets", "prior_tracks")


@query(
    "strict_history_members",
    f"""WITH {MIXES} SELECT m.mix, p.mix AS prior_mix, CAST(m.day - p.day AS INTEGER) AS days_before FROM mixes m JOIN mixes p ON p.dj = m.dj AND p.day < m.day AND m.day - p.day <= 365""",
)
def _(t):
    references, chunks = histories.prior_sets(t.mixes, t.plays.select("mix", "track"), 365)
    d = histories.members(references, chunks, ["dj"])
    return d.select("mix", c("member.prior_mix").alias("prior_mix"), F.date_diff("day", c("member.day")).alias("days_before"))


@query(
    "next_observation_join",
    f"""WITH {SLOTS}, o AS (SELECT mix, position, track AS selected, lead(track) OVER w AS next_selected, count(*) OVER (PARTITION BY mix) - position + 1 AS n_candidates FROM slots WINDOW w AS (PARTITION BY mix ORDER BY position))
 SELECT mix, position, selected, next_selected, n_candidates - 1 AS n_pool FROM o WHERE next_selected IS NOT NULL""",
)
def _(t):
    sizes = t.plays.groupBy("mix").agg(F.count(F.lit(1)).alias("n"))
    obs = t.slots().join(sizes, "mix").select("mix", "position", c("track").alias("selected"), (c("n") - c("position") + 1).alias("n_candidates"))
    return op.next_pick(obs, "mix", "position", t.slot_bins).select("mix", "position", "selected", "next_selected", "n_pool")


@query(
    "two_arm_compare",
    f"""{COMP}, arms AS (SELECT mix, position, 0.35*s_harmonic + 0.65*s_tempo AS x, 0.15*s_harmonic + 0.85*s_tempo AS y FROM comp)
 SELECT mix, position, round(y - x, 6) + 0.0 AS delta, (x >= 0.5) <> (y >= 0.5) AS flipped FROM arms""",
)
def _(t):
    d = scored_pairs(t)
    arm = lambda w: d.select("mix", "position", (w * c("s_harmonic") + (1 - w) * c("s_tempo")).alias("score")).withColumn("flag", c("score") >= 0.5)
    out = op.two_arm_compare(arm(0.35), arm(0.15), ["mix", "position"])
    return out.select("mix", "position", rounded(c("delta")).alias("delta"), "flipped")


@query(
    "semi_anti_coverage",
    """SELECT CASE WHEN v.id IS NULL THEN 'missing' WHEN r.id IS NULL THEN 'extra' ELSE 'covered' END AS state, count(*) AS n FROM
 (SELECT DISTINCT doc_id AS id FROM documents WHERE doc_id % 7 <> 0) r FULL JOIN (SELECT DISTINCT doc_id AS id FROM labels) v USING (id) GROUP BY 1""",
)
def _(t):
    return op.coverage(t.documents.filter(c("doc_id") % 7 != 0), t.raw("labels"), "doc_id")


@query(
    "handle_resolution",
    """WITH a AS (SELECT DISTINCT p_name AS artist, regexp_replace(p_name, '[^a-z0-9]+', '', 'g') AS key FROM part), p AS (SELECT p_partkey AS o, regexp_replace(p_name, '[^a-z0-9]+', '', 'g') AS key, p_size % 4 AS uploads FROM part)
 SELECT artist, 'user_' || arg_min(o, o) AS handle, CASE WHEN arg_min(uploads, o) >= 2 THEN 'confirmed' ELSE 'unsure' END AS certainty FROM a JOIN p USING (key) WHERE length(key) >= 5 GROUP BY artist""",
)
def _(t):
    part = t.raw("part")
    profiles = part.select(
        c("p_partkey").alias("order"),
        F.upper(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("name"),
        F.concat(F.lit("user_"), c("p_partkey")).alias("handle"),
        (c("p_size") % 4).alias("uploads"),
    )
    return op.handle_resolution(part.select(c("p_name").alias("artist")).distinct(), profiles)
