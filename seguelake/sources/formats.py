"""Readers and writers with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seguelake import grouping
from seguelake.functions import hashes

c = F.col
SAFE_ID = r"^[A-Za-z0-9_.\-]+$"
SCHEMA_VERSION = "1"

FRAME = "timestamp_sec double, rms double, spectral_flux double, bass_energy double, low_freq_energy_ratio double, vocal_density_proxy double, onset_density double, pulse_clarity_proxy double, tension_proxy double, release_proxy double, bass_salience double, microtiming_proxy double"
ANALYSIS = (
    "schema_version string, track struct<track_id string, title string, artist string, duration_sec double, bpm_estimate double, key_estimate string, key_confidence double, style_label string, sound_embedding array<double>>, "
    f"features array<struct<{', '.join(f.replace(' ', ': ', 1) for f in FRAME.split(', '))}>>, "
    "segments array<struct<start_sec: double, end_sec: double, segment_type: string>>, "
    "descriptor_curves array<struct<name: string, times_sec: array<double>, values: array<double>>>, "
    "stem_windows array<struct<stem_type: string, start_sec: double, end_sec: double, activity_score: double, continuity_score: double>>"
)
MIX = "id string, title string, genres array<string>, tags array<struct<key: string>>, tracklist array<struct<id: string, title: string>>"
REPORT = (
    "mix_id string, schema_version string, results array<struct<youtube_id: string, track_id: string, alignment: struct<matched: boolean, match_rate: double, normalized_cost: double>, "
    "track_beatgrid: struct<reliable: boolean, bpm: double, quality_score: double>>>, "
    "transitions array<struct<previous_source_id: string, next_source_id: string, transition_length_beats: double, valid: boolean>>, _corrupt string"
)
PLAY = "mix_id string, track_id string, mixin_beat_mix double, mixout_beat_mix double, mixin_time_track double, mixout_time_track double, match_rate double"
ANNOTATION_SCHEMAS = {
    "tracks": "track_id string, title string, artist string, duration_sec double, type string, path string",
    "segments": "track_id string, start_sec double, end_sec double, type string",
    "windows": "window_id string, track_id string, start_sec double, end_sec double, type string, contexts string",
    "pairs": "pair_id string, track_id_a string, track_id_b string, rating double, blind string, comment string",
    "roles": "track_id string, role string, contexts string",
    "contexts": "context_id string, venue_type string, set_role string, style_focus string",
}
RATING = "pair_id string, track_id_a string, track_id_b string, engine_score double, dj_mixability_rating double, comment string, blind string"


def scan_analyses(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """One JSON document per track as tracks, frames, segments, curves and stem_windows; manifests are skipped."""
    docs = spark.read.schema(ANALYSIS).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    docs = docs.withColumn("file", F.regexp_extract(c("_metadata.file_path"), r"([^/]+)\.json$", 1)).filter(~c("file").rlike("manifest"))
    docs = docs.filter(c("track.track_id").rlike(SAFE_ID)).withColumn("track_id", c("track.track_id"))
    rows = lambda field: docs.select("track_id", F.explode(field).alias("x")).select("track_id", "x.*")
    curves = docs.select("track_id", F.explode("descriptor_curves").alias("x")).select(
        "track_id", c("x.name").alias("name"), F.explode(F.arrays_zip(c("x.times_sec").alias("t"), c("x.values").alias("value"))).alias("z")
    )
    return {
        "tracks": docs.select("track.*", "schema_version", (c("schema_version") != SCHEMA_VERSION).alias("old_schema")),
        "frames": rows("features"),
        "segments": rows("segments"),
        "curves": curves.select("track_id", "name", "z.t", "z.value"),
        "stem_windows": rows("stem_windows"),
    }


def scan_mixes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(mixes, slots); the first of several documents with one id is kept and the copies are counted."""
    raw = spark.read.schema(MIX).option("multiLine", False).json(path).filter(F.trim("id") != "")
    raw = raw.withColumn("__at", F.struct(c("_metadata.file_path"), c("_metadata.file_block_start"), F.monotonically_increasing_id()))
    one = raw.groupBy("id").agg(F.min_by(F.struct("title", "genres", "tags", "tracklist"), "__at").alias("m"), F.count(F.lit(1)).alias("copies"))
    mixes = one.select(c("id").alias("mix_id"), "m.title", "m.genres", F.transform("m.tags", lambda x: x["key"]).alias("tags"), "copies")
    slots = one.select(c("id").alias("mix_id"), F.posexplode("m.tracklist").alias("i", "x"))
    track = F.when(F.trim("x.id") != "", F.trim("x.id"))
    return mixes, slots.select("mix_id", (c("i") + 1).alias("position"), track.alias("track_id"), c("x.title").alias("title"))


def scan_reports(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, transitions, corrupt count); hidden shadow files are skipped, corrupt ones counted."""
    raw = spark.read.schema(REPORT).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    raw = raw.filter(~c("_metadata.file_name").startswith("._"))
    good = raw.filter(c("_corrupt").isNull())
    results = good.select("mix_id", F.posexplode("results").alias("i", "r")).select(
        "mix_id", "i", c("r.youtube_id").alias("catalog_id"), c("r.track_id").alias("source_id"), "r.alignment.matched", "r.alignment.match_rate", "r.alignment.normalized_cost", "r.track_beatgrid.reliable"
    )
    transitions = good.select("mix_id", F.explode("transitions").alias("x")).select("mix_id", "x.*")
    return results, transitions, raw.agg(F.count_if(c("_corrupt").isNotNull()).alias("corrupt"), F.count("mix_id").alias("readable"))


def _checked_csv(spark: SparkSession, path: str, schema: str, recursive: bool = False) -> DataFrame:
    """Typed CSV with a header; a byte-order mark is ignored and a missing column fails."""
    wanted = [f.split()[0] for f in schema.split(", ")]
    text = spark.read.option("header", True).option("recursiveFileLookup", recursive).csv(path)
    names = {n.lstrip("﻿").strip(): n for n in text.columns}
    missing = [w for w in wanted if w not in names]
    if missing:
        raise ValueError(f"{path}: missing columns {missing}")
    typed = []
    for field in schema.split(", "):
        name, kind = field.split()
        value = F.nullif(F.trim(text[names[name]]), F.lit(""))
        typed.append((value if kind == "string" else value.try_cast(kind)).alias(name))
    extra = [c("_metadata.file_path").alias("file")] if recursive else []
    d = text.select(*typed, *extra)
    present = F.coalesce(*[c(w).cast("string") for w in wanted])
    return d.filter(present.isNotNull())


def read_annotations(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Six typed tables: lists split on ``;``, flags from 1/true/yes, a blank type becomes unknown."""
    out = {}
    for name, schema in ANNOTATION_SCHEMAS.items():
        d = _checked_csv(spark, f"{folder}/{name}.csv", schema)
        for column in d.columns:
            if column == "type":
                d = d.withColumn(column, F.coalesce(column, F.lit("unknown")))
            elif column in ("contexts", "style_focus"):
                d = d.withColumn(column, F.filter(F.transform(F.split(F.coalesce(column, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != ""))
            elif column == "blind":
                d = d.withColumn(column, F.coalesce(F.lower(column).isin("1", "true", "yes"), F.lit(False)))
        out[name] = d
    return out


def read_ratings(spark: SparkSession, folder: str) -> DataFrame:
    """All rating sheets below a folder; rows without a rating or score are skipped."""
    d = _checked_csv(spark, folder, RATING, recursive=True).filter(c("engine_score").isNotNull() & c("dj_mixability_rating").isNotNull())
    session = F.regexp_extract("file", r"([^/]+)/[^/]+$", 1)
    return d.select(
        session.alias("session"), c("pair_id").alias("pair"), c("engine_score").alias("score"), c("dj_mixability_rating").alias("rating"),
        F.coalesce("comment", F.lit("")).alias("comment"), F.coalesce(c("blind").isin("1", "true", "True"), F.lit(False)).alias("blind"),
    )


def scan_plays(spark: SparkSession, path: str, beat_ids: DataFrame, min_rate: float = 0.4) -> DataFrame:
    """Track plays inside mixes above the match rate whose track has a beat file."""
    return spark.read.schema(PLAY).json(path).filter(c("match_rate") > min_rate).join(beat_ids.select("track_id"), "track_id", "left_semi")


def scan_collection(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(tracks, tempo markers) of a collection XML; non-positive tempos are dropped."""
    schema = "_TrackID string, _Name string, _Artist string, _Location string, _AverageBpm double, TEMPO array<struct<_Inizio: double, _Bpm: double, _Battito: int>>"
    raw = spark.read.format("xml").option("rowTag", "TRACK").schema(schema).load(path).filter(c("_TrackID").isNotNull())
    refs = raw.select(c("_TrackID").alias("track_id"), c("_Name").alias("title"), c("_Artist").alias("artist"), c("_Location").alias("path"), c("_AverageBpm").alias("bpm"))
    marks = raw.select(c("_TrackID").alias("track_id"), F.explode("TEMPO").alias("m")).filter(c("m._Bpm") > 0)
    return refs, marks.select("track_id", c("m._Inizio").alias("t"), c("m._Bpm").alias("bpm"), c("m._Battito").alias("beat"))


def scan_releases(spark: SparkSession, path: str, tag: str = "release", electronic_only: bool = True) -> DataFrame:
    """Release records to one row per track; a track artist overrides the release artist, ``various`` is dropped."""
    artist = "struct<artist: array<struct<name: string>>>"
    schema = (
        f"_id long, title string, year int, artists {artist}, genres struct<genre: array<string>>, styles struct<style: array<string>>, "
        f"tracklist struct<track: array<struct<title: string, artists: {artist}>>>"
    )
    raw = spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    if electronic_only:
        raw = raw.filter(F.array_contains("genres.genre", "Electronic"))
    d = raw.select("*", F.explode_outer("tracklist.track").alias("t"))
    name = F.coalesce(F.get(c("t.artists.artist"), F.lit(0))["name"], F.get(c("artists.artist"), F.lit(0))["name"])
    d = d.select(
        name.alias("artist"), F.coalesce(c("t.title"), c("title")).alias("title"), c("genres.genre").alias("genres"), c("styles.style").alias("styles"), "year", c("_id").alias("id")
    )
    return d.filter(c("artist").isNotNull() & (F.lower(F.trim("artist")) != "various"))


JSON_LD = "struct<`@type`: string, url: string, name: string, byArtist: array<struct<name: string, url: string>>, tracks: array<struct<name: string, url: string, duration: string>>>"
PAGE = "struct<id: string, name: string, songs: array<struct<id: string, title: string, position: int, artist: string>>>"


def extract_pages(pages: DataFrame) -> dict[str, DataFrame]:
    """pages(page_id, url, html): albums, credits, tracks and rejected pages from embedded JSON.

    The linked-data block and the serialized page must name the same album and songs.
    """
    block = lambda pattern: F.get(F.regexp_extract_all("html", F.lit(pattern), F.lit(1)), F.lit(0))
    linked = block(r"(?s)<script[^>]*type=\"application/ld\+json\"[^>]*>(.*?)</script>")
    page = block(r"(?s)<script[^>]*id=\"serialized-server-data\"[^>]*>(.*?)</script>")
    d = pages.select("page_id", "url", F.from_json(linked, JSON_LD).alias("l"), F.from_json(page, PAGE).alias("p"), linked.isNotNull().alias("has_l"), page.isNotNull().alias("has_p"))
    song_ids = F.transform("l.tracks", lambda x: F.regexp_extract(x["url"], r"(\d+)$", 1))
    reason = (
        F.when(~c("has_l"), "no_linked_data")
        .when(~c("has_p"), "no_page_data")
        .when(c("l.name").isNull() | c("p.id").isNull(), "unreadable_json")
        .when(F.regexp_extract("l.url", r"(\d+)$", 1) != c("p.id"), "album_id_mismatch")
        .when(~F.coalesce(song_ids == F.transform("p.songs", lambda x: x["id"]), F.lit(False)), "song_id_mismatch")
    )
    d = d.withColumn("reason", reason)
    good = d.filter(c("reason").isNull())
    songs = good.select(c("p.id").alias("album_id"), F.explode(F.arrays_zip(c("p.songs").alias("s"), c("l.tracks").alias("t"))).alias("x"))
    return {
        "albums": good.select("page_id", c("p.id").alias("album_id"), c("l.name").alias("name"), F.size("p.songs").alias("n_tracks")),
        "credits": good.select(c("p.id").alias("album_id"), F.explode("l.byArtist").alias("a")).select("album_id", "a.name", "a.url"),
        "tracks": songs.select("album_id", c("x.s.position").alias("position"), c("x.s.id").alias("song_id"), c("x.s.title").alias("title"), c("x.t.duration").alias("duration")),
        "rejects": d.filter(c("reason").isNotNull()).select("page_id", "reason"),
    }


def load_embeddings(vectors: DataFrame, key: str, vec: str, dim: int | None = None) -> DataFrame:
    """Vectors with a non-empty id, one size, finite values and a length above zero; any failure rejects the catalogue."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    length = F.aggregate(vec, F.lit(0.0), lambda a, x: a + x * x)
    facts = vectors.agg(
        F.count_if(c(key).isNull() | (F.trim(c(key).cast("string")) == "")).alias("no_id"),
        F.count_if(~finite).alias("not_finite"),
        F.count_if(~(length > 0)).alias("zero"),
        F.min(F.size(vec)).alias("low"),
        F.max(F.size(vec)).alias("high"),
        (F.count(F.lit(1)) - F.count_distinct(key)).alias("copies"),
    )
    bad = (c("f.no_id") > 0) | (c("f.not_finite") > 0) | (c("f.zero") > 0) | (c("f.low") != c("f.high")) | (c("f.copies") > 0)
    if dim is not None:
        bad = bad | (c("f.high") != dim)
    checked = F.when(bad, F.raise_error(F.concat(F.lit("embedding catalogue rejected: "), F.to_json("f"))).cast("boolean")).otherwise(True)
    return vectors.withColumn("f", facts.select(F.struct("*")).scalar()).filter(checked).drop("f")


def fingerprint(df: DataFrame, parts: int = 4096) -> DataFrame:
    """Order-free SHA-256 of the content: sorted row hashes per hash prefix, then the sorted prefixes."""
    rows = df.select(hashes.content(*[c(n) for n in sorted(df.columns)]).alias("h"))
    counts = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    cells = counts.groupBy(F.substring("h", 1, 4).alias("p")).agg(
        F.count(F.lit(1)).alias("k"), F.sum(F.conv(F.substring("h", 5, 12), 16, 10).cast("decimal(38,0)") * c("n")).alias("a"),
        F.sum(F.conv(F.substring("h", 17, 12), 16, 10).cast("decimal(38,0)") * c("n")).alias("b"), F.sum("n").alias("n"),
    )
    line = F.transform(F.array_sort(F.collect_list(F.struct("p", "n", "k", "a", "b"))), lambda x: F.to_json(x))
    return cells.agg(F.sum("n").alias("rows"), F.sha2(F.array_join(line, "\n"), 256).alias("fingerprint"))


def write_snapshot(df: DataFrame, path: str, config: str) -> DataFrame:
    """Parquet payload beside a one-row manifest; the manifest is written last, so its presence marks a whole snapshot."""
    df.write.mode("overwrite").parquet(f"{path}/data")
    manifest = fingerprint(df.sparkSession.read.parquet(f"{path}/data")).withColumn("config", F.lit(config)).withColumn("schema_version", F.lit(SCHEMA_VERSION))
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return df.sparkSession.read.json(f"{path}/manifest")


def write_tables(tables: dict[str, DataFrame], keys: dict[str, list[str]], links: list[tuple[str, str, str, str]], path: str) -> DataFrame:
    """Write entity tables after key and orphan checks; returns rows per table."""
    for name, key in keys.items():
        twice = tables[name].groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(c("n") > 1)
        if not twice.isEmpty():
            raise ValueError(f"{name}: repeated key {key}")
    for child, column, parent, target in links:
        known = tables[parent].select(c(target).alias(column))
        if not tables[child].filter(c(column).isNotNull()).join(known, column, "left_anti").isEmpty():
            raise ValueError(f"{child}.{column}: rows without {parent}.{target}")
    spark, out = next(iter(tables.values())).sparkSession, None
    for name, d in tables.items():
        d.write.mode("overwrite").parquet(f"{path}/{name}")
        n = spark.read.parquet(f"{path}/{name}").agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


def safe_cell(value: Column) -> Column:
    """Text that a spreadsheet will not run as a formula."""
    return F.when(value.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), value)).otherwise(value)


def write_review_sheets(rows: DataFrame, fields: list[str], path: str) -> None:
    """CSV and JSON sheets with a fixed field order."""
    d = rows.select(*fields)
    text = [n for n, t in d.dtypes if t == "string"]
    guarded = d.select(*[safe_cell(c(n)).alias(n) if n in text else c(n) for n in fields])
    guarded.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    d.write.mode("overwrite").json(f"{path}/json")


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Paths and sizes below a folder, without contents."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
