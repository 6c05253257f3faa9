"""Queries that write derived files from the given tables and read them back."""

from pyspark.sql import functions as F

from seguelake.bindings import PAIRS, SLOTS
from seguelake.functions.numeric import rounded
from seguelake.queries import query
from seguelake.queries.evaluation import RATINGS, ratings
from seguelake.queries.pairs import slot_pairs
from seguelake.session import scratch_path
from seguelake.sources import catalog
from seguelake.sources import formats as op

c = F.col


@query("scan_mix_metadata", f"WITH {SLOTS} SELECT CAST(mix AS VARCHAR) AS mix_id, CAST(position AS INTEGER) AS position, CASE WHEN track % 9 <> 0 THEN 't' || track END AS track_id FROM slots")
def _(t):
    path = scratch_path(t.spark, "mixes")
    # a mix is one document; its list is the document's own content
    entry = F.struct("position", F.struct(F.when(c("track") % 9 != 0, F.concat(F.lit("t"), "track")).otherwise("").alias("id"), c("track").cast("string").alias("title")).alias("x"))
    docs = t.slots().groupBy(c("mix").cast("string").alias("id")).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["x"]).alias("tracklist"))
    docs.withColumn("title", F.concat(F.lit("Mix "), "id")).withColumn("genres", F.array(F.lit("house"))).write.json(path)
    return op.scan_mixes(t.spark, path)[1].select("mix_id", "position", "track_id")


@query(
    "scan_alignment_reports",
    "SELECT l_returnflag AS mix_id, count(*) AS n, count(*) FILTER (l_linestatus = 'O') AS matched, round(avg(l_discount), 6) AS rate FROM lineitem GROUP BY 1",
)
def _(t):
    path = scratch_path(t.spark, "reports")
    result = F.struct(
        c("track").cast("string").alias("youtube_id"), c("venue").cast("string").alias("track_id"),
        F.struct((c("status") == "O").alias("matched"), c("discount").alias("match_rate"), c("price").alias("normalized_cost")).alias("alignment"),
    )
    t.plays.select(c("flag").alias("mix_id"), F.array(result).alias("results")).write.json(path)
    results = op.scan_reports(t.spark, path)[0]
    return results.groupBy("mix_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("matched").alias("matched"), rounded(F.avg("match_rate")).alias("rate"))


@query("scan_analysis_documents", "SELECT 'u' || user_id AS track_id, count(*) AS frames, round(avg(value), 6) AS rms FROM events GROUP BY 1")
def _(t):
    path = scratch_path(t.spark, "analyses")
    # one file per frame document keeps every document small
    doc = t.frames.select(
        F.lit("1").alias("schema_version"), F.struct(F.concat(F.lit("u"), "track").alias("track_id"), F.lit(120.0).alias("bpm_estimate")).alias("track"),
        F.array(F.struct(c("t").alias("timestamp_sec"), c("value").alias("rms"))).alias("features"),
    )
    doc.write.option("maxRecordsPerFile", 100000).json(path)
    frames = t.spark.read.schema(op.ANALYSIS).json(path).select(c("track.track_id").alias("track_id"), F.explode("features").alias("x"))
    return frames.groupBy("track_id").agg(F.count(F.lit(1)).alias("frames"), rounded(F.avg("x.rms")).alias("rms"))


@query(
    "read_annotations",
    "SELECT 'p' || p_partkey AS track_id, CASE WHEN p_size % 4 = 0 THEN 'unknown' ELSE p_type END AS type, CAST(p_size AS DOUBLE) AS duration_sec FROM part",
)
def _(t):
    path = scratch_path(t.spark, "annotations")
    part = t.raw("part")
    part.select(
        F.concat(F.lit("p"), "p_partkey").alias("track_id"), c("p_name").alias("title"), c("p_brand").alias("artist"), c("p_size").alias("duration_sec"),
        F.when(c("p_size") % 4 != 0, c("p_type")).alias("type"), F.lit("x.wav").alias("path"),
    ).write.option("header", True).csv(f"{path}/tracks.csv")
    for name, schema in op.ANNOTATION_SCHEMAS.items():
        if name != "tracks":
            part.limit(0).select(*[F.lit(None).cast("string").alias(f.split()[0]) for f in schema.split(", ")]).coalesce(1).write.option("header", True).csv(f"{path}/{name}.csv")
    return op.read_annotations(t.spark, path)["tracks"].select("track_id", "type", "duration_sec")


@query("read_rating_sessions", f"WITH {RATINGS} SELECT session, count(*) AS n, round(avg(score), 6) AS score, round(avg(rating), 6) AS rating, count(*) FILTER (blind) AS blind FROM ratings GROUP BY 1")
def _(t):
    path = scratch_path(t.spark, "ratings")
    d = ratings(t).select(
        c("session"), c("pair").cast("string").alias("pair_id"), F.lit("a").alias("track_id_a"), F.lit("b").alias("track_id_b"), c("score").alias("engine_score"),
        c("rating").alias("dj_mixability_rating"), "comment", c("blind").cast("string").alias("blind"),
    )
    d.write.partitionBy("session").option("header", True).csv(path)
    out = op.read_ratings(t.spark, path).withColumn("session", F.regexp_extract("session", r"(\d+)$", 1).cast("long"))
    return out.groupBy("session").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("score")).alias("score"), rounded(F.avg("rating")).alias("rating"), F.count_if("blind").alias("blind"))


@query("scan_play_alignments", "SELECT CAST(l_orderkey AS VARCHAR) AS mix_id, count(*) AS n FROM lineitem WHERE l_discount * 10 > 0.4 AND l_partkey % 5 <> 0 GROUP BY 1")
def _(t):
    path = scratch_path(t.spark, "plays")
    t.plays.select(c("mix").cast("string").alias("mix_id"), c("track").cast("string").alias("track_id"), (c("discount") * 10).alias("match_rate")).write.json(path)
    beats = t.tracks.filter(c("track") % 5 != 0).select(c("track").cast("string").alias("track_id"))
    return op.scan_plays(t.spark, path, beats).groupBy("mix_id").agg(F.count(F.lit(1)).alias("n"))


@query("scan_collection_xml", "SELECT CAST(p_partkey AS VARCHAR) AS track_id, CAST(p_size + 90 AS DOUBLE) AS bpm, 1 AS beat FROM part WHERE p_partkey % 6 <> 0")
def _(t):
    path = scratch_path(t.spark, "collection")
    bpm = (c("p_size") + 90).cast("double")
    mark = F.struct(F.lit(0.25).alias("_Inizio"), F.when(c("p_partkey") % 6 != 0, bpm).otherwise(0.0).alias("_Bpm"), F.lit(1).alias("_Battito"))
    d = t.raw("part").select(c("p_partkey").alias("_TrackID"), c("p_name").alias("_Name"), bpm.alias("_AverageBpm"), F.array(mark).alias("TEMPO"))
    d.write.format("xml").option("rootTag", "COLLECTION").option("rowTag", "TRACK").save(path)
    return op.scan_collection(t.spark, path)[1].select("track_id", "bpm", "beat")


@query(
    "scan_release_dump",
    "SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'Guest' ELSE p_brand END AS artist, p_name || ' A' AS title, p_size AS year FROM part WHERE p_partkey % 3 <> 0",
)
def _(t):
    path = scratch_path(t.spark, "releases")
    who = lambda name: F.struct(F.array(F.struct(name.alias("name"))).alias("artist"))
    song = F.struct(F.concat("p_name", F.lit(" A")).alias("title"), F.when(c("p_partkey") % 4 == 0, who(F.lit("Guest"))).alias("artists"))
    d = t.raw("part").select(
        c("p_partkey").alias("_id"), c("p_name").alias("title"), c("p_size").alias("year"), who(c("p_brand")).alias("artists"),
        F.struct(F.array(F.when(c("p_partkey") % 3 != 0, "Electronic").otherwise("Rock")).alias("genre")).alias("genres"), F.struct(F.array(c("p_type")).alias("style")).alias("styles"),
        F.struct(F.array(song).alias("track")).alias("tracklist"),
    )
    d.write.format("xml").option("rootTag", "releases").option("rowTag", "release").option("compression", "gzip").save(path)
    return op.scan_releases(t.spark, path).select("id", "artist", "title", "year")


def embedded(t):
    """The given pages with two embedded JSON blocks made from their own id and address."""
    pid = c("page_id")
    album = F.concat(F.lit("9"), pid)
    songs = F.array(*[F.struct(F.concat(album, F.lit(str(i))).alias("id"), F.concat(F.lit("Song "), F.lit(i)).alias("title"), F.lit(i).alias("position"), F.lit("A").alias("artist")) for i in (1, 2)])
    tracks = F.array(*[F.struct(F.concat(F.lit("Song "), F.lit(i)).alias("name"), F.concat(F.lit("https://x/"), album, F.lit(str(i))).alias("url"), F.lit("PT3M").alias("duration")) for i in (1, 2)])
    linked = F.to_json(F.struct(F.lit("MusicAlbum").alias("@type"), F.concat(F.lit("https://x/"), F.when(pid % 7 == 0, F.lit("1")).otherwise(album)).alias("url"), F.concat(F.lit("Album "), pid).alias("name"), F.array(F.struct(F.lit("A").alias("name"), F.lit("u").alias("url"))).alias("byArtist"), tracks.alias("tracks")))
    page = F.to_json(F.struct(album.alias("id"), F.concat(F.lit("Album "), pid).alias("name"), songs.alias("songs")))
    one = F.concat(F.lit('<script type="application/ld+json">'), linked, F.lit("</script>"))
    two = F.when(pid % 5 == 0, "").otherwise(F.concat(F.lit('<script id="serialized-server-data">'), page, F.lit("</script>")))
    return t.raw("pages").withColumn("html", F.concat("html", one, two))


@query("extract_page_json", "SELECT '9' || page_id AS album_id, 'Album ' || page_id AS name, 2 AS n_tracks FROM pages WHERE page_id % 5 <> 0 AND page_id % 7 <> 0")
def _(t):
    return op.extract_pages(embedded(t))["albums"].select("album_id", "name", "n_tracks")


@query("extract_page_rejects", "SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'no_page_data' ELSE 'album_id_mismatch' END AS reason FROM pages WHERE page_id % 5 = 0 OR page_id % 7 = 0")
def _(t):
    return op.extract_pages(embedded(t))["rejects"]


@query("load_embeddings", "SELECT vec_id AS id, len(embedding)::INTEGER AS dims FROM embeddings")
def _(t):
    return op.load_embeddings(t.vectors, "id", "vec", 64).select("id", F.size("vec").alias("dims"))


@query("write_snapshot")
def _(t):
    return op.write_snapshot(slot_pairs(t).select("mix", "position", "a", "b"), scratch_path(t.spark, "snapshot"), "pairs")


@query("write_relational_catalog", f"WITH {SLOTS} SELECT 'mixes' AS \"table\", count(*) AS n FROM orders UNION ALL SELECT 'tracks', count(*) FROM part UNION ALL SELECT 'slots', count(*) FROM slots")
def _(t):
    tables = {"mixes": t.mixes, "tracks": t.tracks, "slots": t.slots()}
    links = [("slots", "mix", "mixes", "mix"), ("slots", "track", "tracks", "track")]
    return op.write_tables(tables, {"mixes": ["mix"], "tracks": ["track"], "slots": ["mix", "position"]}, links, scratch_path(t.spark, "catalog"))


NESTED = f"""{SLOTS}, sz AS (SELECT mix, count(*) AS n FROM slots GROUP BY 1), good AS (SELECT mix, o_custkey AS dj, n FROM sz JOIN orders ON o_orderkey = mix WHERE mix % 50 <> 0), gs AS (SELECT slots.* FROM slots JOIN good USING (mix)),
 tr AS (SELECT track, min(mix * 1000 + position) AS first FROM gs GROUP BY 1), lone AS (SELECT tr.track, first // 1000 AS mix FROM tr WHERE tr.track % 8 = 0),
 pf AS (SELECT 'C' || dj AS p FROM good UNION SELECT 'C' || (dj + 1) FROM good WHERE mix % 9 = 0 UNION SELECT 'A' || (track % 30) FROM gs WHERE track % 8 <> 0)"""


def nested_albums(t):
    """One nested row per mix; every fiftieth states a wrong number of tracks."""
    person = lambda name: F.struct(name.alias("id"), F.concat(F.lit("name "), name).alias("name"))
    artist = F.concat(F.lit("A"), c("track") % 30)
    track = F.struct(
        "position", c("track").alias("song"), F.concat(F.lit("t"), c("track")).alias("title"), (60_000 + c("track") * 10).alias("duration_ms"),
        F.when(c("track") % 8 != 0, F.array(person(artist))).otherwise(F.array().cast("array<struct<id: string, name: string>>")).alias("artists"),
    )
    listed = t.slots().groupBy("mix").agg(F.collect_list(track).alias("tracks"))  # a mix
    d = t.mixes.join(listed, "mix")
    lead, guest = person(F.concat(F.lit("C"), c("dj"))), person(F.concat(F.lit("C"), c("dj") + 1))
    shelf = lambda program, place: F.struct(program.alias("program"), place.alias("position"))
    main, second = shelf(c("priority"), c("mix") % 5 + 1), shelf(F.concat(F.lit("state "), c("state")), F.lit(1).cast("long"))
    return d.select(
        c("mix").alias("album"), F.concat(F.lit("mix "), c("mix")).alias("name"), (F.size("tracks") + F.when(c("mix") % 50 == 0, 1).otherwise(0)).alias("track_count"),
        F.when(c("mix") % 9 == 0, F.array(lead, guest)).otherwise(F.array(lead)).alias("creators"), F.when(c("mix") % 3 == 0, F.array(main, second)).otherwise(F.array(main)).alias("shelves"), "tracks",
    )


@query(
    "publish_catalog",
    f"""WITH {NESTED} SELECT 'metadata' AS "table", 2::BIGINT AS n UNION ALL SELECT 'performers', count(*) FROM pf UNION ALL SELECT 'programs', (SELECT count(DISTINCT o_orderpriority) FROM orders JOIN good ON mix = o_orderkey) + (SELECT count(DISTINCT o_orderstatus) FROM orders JOIN good ON mix = o_orderkey WHERE mix % 3 = 0)
 UNION ALL SELECT 'mixes', count(*) FROM good UNION ALL SELECT 'mix_programs', count(*) + count(*) FILTER (mix % 3 = 0) FROM good UNION ALL SELECT 'mix_performers', count(*) + count(*) FILTER (mix % 9 = 0) FROM good UNION ALL SELECT 'tracks', count(*) FROM tr
 UNION ALL SELECT 'track_artists', (SELECT count(*) FROM tr) + (SELECT count(*) FROM lone WHERE mix % 9 = 0) UNION ALL SELECT 'mix_tracks', count(*) FROM gs UNION ALL SELECT 'observed_adjacencies', (SELECT count(*) FROM gs) - (SELECT count(*) FROM good)
 UNION ALL SELECT 'rejected_items', count(*) FROM sz WHERE mix % 50 = 0 UNION ALL SELECT 'review_items', (SELECT count(*) FROM lone) + (SELECT count(*) FROM good WHERE mix % 9 = 0)""",
)
def _(t):
    return catalog.publish(catalog.catalog_tables(nested_albums(t), "plays"), scratch_path(t.spark, "catalog"))


@query("catalog_adjacencies", f"""WITH {NESTED} SELECT 'mix:' || mix AS mix_id, CAST(position AS INTEGER) AS position, 'track:' || track AS from_track_id, 'track:' || nxt AS to_track_id FROM (SELECT *, lead(track) OVER (PARTITION BY mix ORDER BY position) AS nxt FROM gs) WHERE nxt IS NOT NULL""")
def _(t):
    path = scratch_path(t.spark, "catalog")
    catalog.publish(catalog.catalog_tables(nested_albums(t), "plays"), path)
    return catalog.published(t.spark, path, "observed_adjacencies").select("mix_id", "position", "from_track_id", "to_track_id")


@query("write_review_sheets", f"WITH {SLOTS}, {PAIRS} SELECT mix, position, CASE WHEN a % 4 = 0 THEN '''=' || a ELSE 't' || a END AS note FROM pairs")
def _(t):
    path = scratch_path(t.spark, "sheets")
    d = slot_pairs(t).withColumn("note", F.when(c("a") % 4 == 0, F.concat(F.lit("="), "a")).otherwise(F.concat(F.lit("t"), "a")))
    op.write_review_sheets(d, ["mix", "position", "note"], path)
    return t.spark.read.option("header", True).schema("mix long, position long, note string").csv(f"{path}/csv")
