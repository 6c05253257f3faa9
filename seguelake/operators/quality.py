"""Validation, catalogue checks and readiness gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seguelake import grouping
from seguelake.functions import text
from seguelake.functions.numeric import rounded

c = F.col
TIERS = {"lean": 0, "standard": 1, "full": 2}


def _issue(df: DataFrame, code: str, level: str, key: Column) -> DataFrame:
    return df.select(F.lit(code).alias("code"), F.lit(level).alias("level"), key.cast("string").alias("key"))


def validate_annotations(tracks: DataFrame, windows: DataFrame, pairs: DataFrame, roles: DataFrame, known_roles: list[str]) -> DataFrame:
    """tracks(track, duration, path), windows(wid, track, start, end, context), pairs(pair, a, b, rating, comment), roles(track, role).

    One row per violation: unknown ids, reversed or overlong spans, unknown roles (errors);
    extreme ratings without a comment and missing files (warnings).
    """
    ids = tracks.select("track")
    timed = windows.join(tracks.select("track", "duration"), "track", "left")
    parts = [
        _issue(windows.join(ids, "track", "left_anti"), "unknown_window_track", "error", c("wid")),
        _issue(windows.filter(c("start") >= c("end")), "reversed_window", "error", c("wid")),
        _issue(timed.filter(c("end") > c("duration") + 1.0), "window_past_end", "error", c("wid")),
        _issue(pairs.join(ids.withColumnRenamed("track", "a"), "a", "left_anti"), "unknown_pair_track", "error", c("pair")),
        _issue(pairs.join(ids.withColumnRenamed("track", "b"), "b", "left_anti"), "unknown_pair_track", "error", c("pair")),
        _issue(roles.filter(~c("role").isin(*known_roles)), "unknown_role", "error", c("track")),
        _issue(pairs.filter(c("rating").isin(1, 5) & (F.coalesce("comment", F.lit("")) == "")), "extreme_without_comment", "warning", c("pair")),
        _issue(tracks.filter(F.coalesce("path", F.lit("")) == ""), "missing_file", "warning", c("track")),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def catalog_violations(albums: DataFrame, rows: DataFrame) -> DataFrame:
    """albums(album, n_tracks, creator), rows(album, position, song, title): rows per violated rule."""
    twice = albums.groupBy("album").agg(F.count(F.lit(1)).alias("n")).filter(c("n") > 1)
    sizes = rows.groupBy("album").agg(
        F.count(F.lit(1)).alias("n"), F.max("position").alias("top"), F.min("position").alias("low"), F.count_distinct("position").alias("d")
    )
    stated = albums.groupBy("album").agg(F.max("n_tracks").alias("n_tracks"))
    names = rows.filter(c("song").isNotNull()).groupBy("song").agg(F.count_distinct("title").alias("n")).filter(c("n") > 1)
    parts = [
        _issue(twice, "duplicate_album", "error", c("album")),
        _issue(sizes.join(stated, "album").filter(c("n") != c("n_tracks")), "count_mismatch", "error", c("album")),
        _issue(sizes.filter((c("top") != c("n")) | (c("low") != 1) | (c("d") != c("n"))), "positions_not_contiguous", "error", c("album")),
        _issue(names, "conflicting_title", "error", c("song")),
        _issue(rows.join(albums.select("album"), "album", "left_anti").select("album").distinct(), "orphan_row", "error", c("album")),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def normalize_catalog(albums: DataFrame, rows: DataFrame, strict: bool = True) -> dict[str, DataFrame]:
    """Entity tables of a catalogue snapshot; with ``strict`` any violation stops the job.

    A row without a credit takes the album's creator and is listed for review.
    """
    violations = catalog_violations(albums, rows)
    if strict:
        worst = violations.groupBy("code").agg(F.count(F.lit(1)).alias("n")).orderBy("code").collect()  # one row per rule
        if worst:
            raise ValueError("catalogue violations: " + ", ".join(f"{r['code']}={r['n']}" for r in worst))
    credited = rows.join(albums.select("album", "creator").dropDuplicates(["album"]), "album")
    credited = credited.withColumn("artist_used", F.coalesce("artist", "creator")).withColumn(
        "credit_source", F.when(c("artist").isNull(), "album_creator").otherwise("row")
    )
    placeholder = text.is_placeholder(c("title"))
    return {
        "performers": albums.select(text.compact_key(c("creator")).alias("key"), "creator").groupBy("key").agg(F.min("creator").alias("name")),
        "mixes": albums.select("album", "creator", "n_tracks"),
        "tracks": credited.filter(~placeholder).groupBy("song").agg(F.min("title").alias("title"), F.count(F.lit(1)).alias("plays")),
        "slots": credited.select("album", "position", "song", "artist_used", "credit_source", placeholder.alias("placeholder")),
        "review": credited.filter(c("credit_source") == "album_creator").select("album", "position", F.lit("missing_credit").alias("code")),
        "violations": violations,
    }


def ordering_readiness(observations: DataFrame, features: DataFrame, djs: DataFrame, min_cases: int, min_djs: int) -> DataFrame:
    """observations(case, mix, item), features(item), djs(mix, dj): eligible cases, mixes, DJs and what blocks training."""
    d = observations.join(features.select("item", F.lit(1).alias("f")).distinct(), "item", "left").join(djs, "mix", "left")
    cases = d.groupBy("case", "mix").agg(F.count_if(c("f").isNull()).alias("gaps"), F.max("dj").alias("dj"))
    ok = (c("gaps") == 0) & c("dj").isNotNull()
    out = cases.agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if(c("gaps") > 0).alias("without_features"),
        F.count_if(c("dj").isNull()).alias("without_identity"),
        F.count_if(ok).alias("eligible"),
        F.count_distinct(F.when(ok, c("mix"))).alias("mixes"),
        F.count_distinct(F.when(ok, c("dj"))).alias("djs"),
    )
    blockers = F.array_compact(F.array(F.when(c("eligible") < min_cases, F.lit("too_few_cases")), F.when(c("djs") < min_djs, F.lit("too_few_djs"))))
    return out.withColumn("blockers", F.array_join(blockers, ","))


def review_reasons(mixes: DataFrame, review: DataFrame, history: DataFrame, min_tracks: int) -> DataFrame:
    """mixes(mix, n_tracks), review(mix, status, day), history(mix, prior_sets): first reason that excludes a set."""
    decided = review.groupBy("mix").agg(F.count(F.lit(1)).alias("decisions"), F.max("status").alias("status"), F.max("day").alias("day"))
    d = mixes.join(decided, "mix", "left").join(history, "mix", "left")
    reason = (
        F.when(c("decisions").isNull(), "undecided")
        .when(c("decisions") > 1, "decided_twice")
        .when(c("status") != "approved", "rejected")
        .when(c("day").isNull(), "no_exact_date")
        .when(c("n_tracks") < min_tracks, "too_short")
        .when(F.coalesce("prior_sets", F.lit(0)) == 0, "no_history")
        .otherwise("observation")
    )
    return d.select("mix", reason.alias("reason"))


def review_gate(reasons: DataFrame, djs: DataFrame, min_cases: int = 100, min_djs: int = 20) -> DataFrame:
    d = reasons.filter(c("reason") == "observation").join(djs, "mix")
    return d.agg(F.count(F.lit(1)).alias("cases"), F.count_distinct("dj").alias("djs")).withColumn("open", (c("cases") >= min_cases) & (c("djs") >= min_djs))


def gap_buckets(library: DataFrame, matched: DataFrame, known_artists: DataFrame, music: Column, version: Column) -> DataFrame:
    """library(id, artist, title): every row in exactly one bucket; counts per bucket."""
    d = library.join(matched.select("id", F.lit(1).alias("m")).distinct(), "id", "left").join(
        known_artists.select("artist", F.lit(1).alias("k")).distinct(), "artist", "left"
    )
    bucket = (
        F.when(~music, "not_music").when(c("m").isNotNull(), "found").when(c("k").isNull(), "artist_unknown").when(version, "version_title").otherwise("plain_title")
    )
    return d.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def grid_diagnostics(beats: DataFrame, tempos: DataFrame, by: str, bins) -> DataFrame:
    """beats(by, t), tempos(by, bpm): interval variation, grid error, coverage, mismatch and flags of a fixed grid."""

    def step(d: DataFrame, w) -> DataFrame:
        return d.withColumn("gap", F.lead("t").over(w()) - c("t"))

    d = grouping.windowed(beats.select(by, "t"), [by], ["t"], bins, 1, step)
    first = beats.groupBy(by).agg(F.min("t").alias("t0"))
    d = d.join(tempos, by).join(first, by)
    phase = (c("t") - c("t0")) * c("bpm") / 60.0
    err = F.abs(phase - F.rint(phase)) * 60.0 / c("bpm")
    live = F.when(c("gap") > 0, c("gap"))
    g = d.groupBy(by, "bpm").agg(
        F.count(F.lit(1)).alias("beats"), F.avg(err).alias("mean_error"), F.max(err).alias("max_error"), (F.max("t") - F.min("t")).alias("coverage"),
        (F.stddev_pop(live) / F.avg(live)).alias("cv"), F.count_if(c("gap") <= 0).alias("bad"),
    )
    mid = grouping.quantiles(d.filter(c("gap") > 0), [by], "gap", {"mid": 0.5})
    g = g.join(mid, by, "left").withColumn("mismatch", F.abs(60.0 / c("mid") - c("bpm")) / c("bpm") * 100.0)
    flags = F.array_compact(
        F.array(
            F.when(c("bad") > 0, F.lit("non_monotonic_beats")), F.when(c("beats") < 8, F.lit("insufficient_beats")), F.when(c("coverage") < 16.0, F.lit("short_beat_coverage")),
            F.when(c("cv") > 0.12, F.lit("irregular_beat_intervals")), F.when(c("mismatch") > 0.8, F.lit("grid_drift")),
        )
    )
    beat = 60.0 / c("bpm")
    quality = (
        1.0 - F.least(F.lit(0.45), c("mismatch") / 2.0) - F.least(F.lit(0.25), c("mean_error") / beat * 0.6)
        - F.least(F.lit(0.15), c("max_error") / beat * 0.2) - F.coalesce(F.least(F.lit(0.35), c("cv") / 0.12 * 0.35), F.lit(0.0))
    )
    return g.withColumn("flags", F.array_join(flags, ",")).withColumn("quality", F.greatest(F.least(quality, F.lit(1.0)), F.lit(0.0)))


def incremental_work(inputs: DataFrame, ledger: DataFrame, engine: str, schema: str, formula: str, tier: str) -> DataFrame:
    """inputs(id, checksum), ledger(id, status, artifact, checksum, engine, schema, formula, tier): first reason to redo, or reuse."""
    from seguelake.functions.numeric import lookup

    seen = ledger.select("id", *[c(x).alias(f"l_{x}") for x in ("status", "artifact", "checksum", "engine", "schema", "formula", "tier")])
    d = inputs.join(seen, "id", "left")
    reason = (
        F.when(c("l_status").isNull(), "not_recorded")
        .when(c("l_status") == "failed", "failed_before")
        .when(c("l_artifact").isNull(), "artifact_missing")
        .when(~c("l_checksum").eqNullSafe(c("checksum")), "source_changed")
        .when(~c("l_engine").eqNullSafe(F.lit(engine)), "engine_changed")
        .when(~c("l_schema").eqNullSafe(F.lit(schema)), "schema_changed")
        .when(~c("l_formula").eqNullSafe(F.lit(formula)), "formula_changed")
        .when(lookup(c("l_tier"), TIERS, -1) < TIERS[tier], "tier_too_low")
        .otherwise("reuse")
    )
    return d.select("id", reason.alias("reason"))


def inventory_status(required: DataFrame, files: DataFrame, extensions: list[str]) -> DataFrame:
    """required(id), files(path): resolved, missing, ambiguous or unsupported per id, by file stem."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    f = files.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("id"), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("ext"))
    counted = f.groupBy("id").agg(F.count_if(c("ext").isin(*extensions)).alias("good"), F.count(F.lit(1)).alias("all"))
    d = required.select(c("id").cast("string").alias("id")).join(counted, "id", "left")
    status = F.when(c("all").isNull(), "missing").when(c("good") == 1, "resolved").when(c("good") > 1, "ambiguous").otherwise("unsupported")
    return d.select("id", status.alias("status"))
