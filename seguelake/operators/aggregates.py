"""Library, performer, venue and mix profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seguelake import grouping
from seguelake.functions import text, vectors
from seguelake.functions.numeric import rounded
from seguelake.session import cut_lineage

c = F.col
SAFE_RELATIONS = ("exact", "relative_major_minor", "adjacent_same_mode")


def share_below(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Number of rows of the group with a smaller value, through running counts per distinct value."""
    cells = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    binned = grouping.quantile_bins(cells, by, value) if grouping.large_groups(cells, by) is not None else cells.withColumn("__qbin", F.lit(0))
    ran = grouping.running(binned, by, [value], [c("__qbin")], sums={"__run": c("__n")})
    ran = ran.select(*by, value, (c("__run") - c("__n")).alias(name))
    return df.join(ran, [*by, value], "left")


def library_profile(tracks: DataFrame, styles: list[str], low: float, high: float) -> DataFrame:
    """One row of counts and tempo facts; the dominant style is the most frequent, then the first by name."""
    label = F.lower(F.trim("style"))
    counts = tracks.filter(c("style").isNotNull()).groupBy(label.alias("s")).agg(F.count(F.lit(1)).alias("n"))
    top = counts.agg(F.min_by("s", F.struct(-c("n"), c("s"))))
    return tracks.agg(
        F.count(F.lit(1)).alias("tracks"),
        rounded(F.min("bpm"), 2).alias("bpm_min"),
        rounded(F.max("bpm"), 2).alias("bpm_max"),
        rounded(F.avg("bpm"), 2).alias("bpm_mean"),
        F.count_if(c("style").isNull()).alias("missing_style"),
        F.count_if(label.isin(*styles)).alias("preferred"),
        F.count_if(c("bpm").between(low, high)).alias("in_tempo"),
    ).withColumn("dominant_style", top.scalar())


def genre_coverage(tracks: DataFrame, section: str, genre: str) -> DataFrame:
    """Counts per section and genre with section subtotals and the grand total."""
    return (
        tracks.rollup(section, genre)
        .agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
        .select(
            F.when(c("g") == 3, "all").otherwise(F.coalesce(section, F.lit("foreign"))).alias("section"),
            F.when(c("g") >= 1, "all").otherwise(F.coalesce(genre, F.lit("untagged"))).alias("genre"),
            "n",
        )
    )


def _top_list(df: DataFrame, by: str, item: str, k: int, least: int, name: str) -> DataFrame:
    """``item:count`` of the k most frequent items per group, joined by commas."""
    counts = df.filter(c(item).isNotNull()).groupBy(by, item).agg(F.count(F.lit(1)).alias("n")).filter(c("n") >= least)
    top = grouping.first_rows(counts, [by], [c("n").desc(), c(item)], k, "r")
    line = F.transform(F.array_sort(F.collect_list(F.struct("r", F.concat_ws(":", item, "n").alias("x")))), lambda s: s["x"])
    return top.groupBy(by).agg(F.array_join(line, ",").alias(name))


def performer_profiles(plays: DataFrame, min_sets: int = 2) -> DataFrame:
    """plays(dj, mix, track, artist, genre): volume and favourites per performer."""
    base = plays.groupBy("dj").agg(
        F.count_distinct("mix").alias("n_sets"),
        F.count("track").alias("n_tracks"),
        F.count_distinct("track").alias("n_unique"),
    )
    base = base.filter(c("n_sets") >= min_sets).withColumn("avg_tracks", rounded(c("n_tracks") / c("n_sets"), 1))
    mixes = plays.select("dj", "mix", "genre").distinct()
    out = base
    for part in (
        _top_list(mixes, "dj", "genre", 5, 1, "genres"),
        _top_list(plays, "dj", "artist", 12, 1, "artists"),
        _top_list(plays, "dj", "track", 12, 2, "favourites"),
    ):
        out = out.join(part, "dj", "left")
    return out


def _modal(df: DataFrame, by: str, item: str) -> DataFrame:
    counts = df.groupBy(by, item).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(by).agg(F.min_by(item, F.struct(-c("n"), c(item))).alias(item))


def venue_profile(gigs: DataFrame, excluded: list[str]) -> DataFrame:
    """gigs(venue, artist, country, city, year): size, loyalty and span per venue."""
    live = gigs.filter(~F.lower(F.trim(c("venue").cast("string"))).isin("", *excluded))
    pairs = live.groupBy("venue", "artist").agg(F.count(F.lit(1)).alias("n"), F.min("year").alias("y0"), F.max("year").alias("y1"))
    out = pairs.groupBy("venue").agg(
        F.sum("n").alias("gigs"),
        F.count(F.lit(1)).alias("artists"),
        F.count_if(c("n") >= 2).alias("returning"),
        F.min("y0").alias("first_year"),
        F.max("y1").alias("last_year"),
    )
    out = out.withColumn("per_artist", rounded(c("gigs") / c("artists"), 2)).withColumn(
        "returning_pct", rounded(c("returning") * 100.0 / c("artists"), 1)
    )
    return out.join(_modal(live, "venue", "country"), "venue").join(_modal(live, "venue", "city"), "venue")


def residency_pairs(gigs: DataFrame, min_n: int = 2) -> DataFrame:
    return (
        gigs.groupBy("artist", "venue")
        .agg(F.count(F.lit(1)).alias("n"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count_distinct("year").alias("years"))
        .filter(c("n") >= min_n)
    )


def artist_mobility(gigs: DataFrame) -> DataFrame:
    pairs = gigs.groupBy("artist", "venue").agg(F.count(F.lit(1)).alias("n"))
    out = pairs.groupBy("artist").agg(
        F.sum("n").alias("gigs"),
        F.count(F.lit(1)).alias("venues"),
        F.min_by(F.struct("venue", "n"), F.struct(-c("n"), c("venue"))).alias("top"),
        F.count_if(c("n") >= 2).alias("repeat_hosts"),
    )
    return out.select(
        "artist", "gigs", "venues", c("top.venue").alias("top_venue"), rounded(c("top.n") * 100.0 / c("gigs"), 1).alias("top_pct"), "repeat_hosts"
    )


def multi_label_hits(df: DataFrame, title: str, labels: dict[str, str]) -> DataFrame:
    """One row per (row, label) whose pattern occurs in the title."""
    marks = F.array_compact(F.array(*[F.when(c(title).rlike(p), n) for n, p in labels.items()]))
    return df.withColumn("label", F.explode(marks))


def canonical_items(rows: DataFrame, key: Column, player: str, year: str, source: str, label: str, order: str) -> DataFrame:
    """Occurrences, distinct players, years, sources and first label per key, numbered by size then key."""
    keyed = rows.withColumn("key", key)
    grouped = keyed.groupBy("key").agg(
        F.count(F.lit(1)).alias("occurrences"),
        F.count_distinct(player).alias("players"),
        F.array_join(F.sort_array(F.collect_set(year)), ",").alias("years"),
        F.array_join(F.sort_array(F.collect_set(source)), ",").alias("sources"),
        F.min_by(label, F.when(F.coalesce(F.trim(label), F.lit("")) != "", c(order))).alias("label"),
    )
    ranked = grouped.withColumn("__neg", -c("occurrences"))
    return grouping.position(ranked, [], ["__neg", "key"], [c("__neg"), F.substring("key", 1, 8)], "item_id").drop("__neg")


def resolve_entities(names: DataFrame, name: str, priority: str) -> tuple[DataFrame, DataFrame]:
    """(entities numbered in key order with the spelling of the first source, alias rows)."""
    keyed = names.withColumn("key", text.compact_key(c(name))).filter(c("key") != "")
    first = keyed.groupBy("key").agg(F.min_by(name, F.struct(priority, name)).alias("spelling"), F.count_distinct(priority).alias("n_sources"))
    entities = grouping.position(first, [], ["key"], [F.substring("key", 1, 8)], "entity_id")
    aliases = keyed.select("key", c(name).alias("alias")).distinct().join(entities.select("key", "entity_id", "spelling"), "key")
    return entities, aliases.filter(c("alias") != c("spelling")).select("entity_id", "alias")


def frame_summary(frames: DataFrame, by: str, specs: dict[str, bool], required: list[str]) -> DataFrame:
    """mean, population std, p10, p90 and missing share per descriptor; a gap in a required one drops the group.

    ``specs`` maps a column to whether log(1 + x) is taken first.
    """
    d = frames.select(by, *[(F.log1p(n) if log else c(n)).cast("double").alias(n) for n, log in specs.items()])
    aggs = []
    for n in specs:
        aggs += [
            F.avg(n).alias(f"{n}_mean"),
            F.stddev_pop(n).alias(f"{n}_std"),
            (1.0 - F.count(n) / F.count(F.lit(1))).alias(f"{n}_missing"),
        ]
    out = d.groupBy(by).agg(*aggs)
    for n in specs:
        out = out.join(grouping.quantiles(d, [by], n, {f"{n}_p10": 0.1, f"{n}_p90": 0.9}), by, "left")
    for n in required:
        out = out.filter(c(f"{n}_missing") == 0)
    return out


def segment_fractions(segments: DataFrame, by: str, types: list[str]) -> DataFrame:
    """log(1 + count) and share of the duration per segment type."""
    length = F.greatest(F.lit(0.0), c("end") - c("start"))
    out = segments.groupBy(by).agg(
        F.log1p(F.count(F.lit(1)).cast("double")).alias("log_count"),
        F.sum(length).alias("total"),
        *[F.sum(F.when(c("kind") == k, length).otherwise(0.0)).alias(k) for k in types],
    )
    share = lambda k: F.when(c("total") > 0, c(k) / c("total")).otherwise(0.0).alias(k)
    return out.select(by, "log_count", *[share(k) for k in types])


def consensus(readings: DataFrame, by: str, value: str, reliable: Column, name: str) -> DataFrame:
    """Median of the reliable positive readings of each group."""
    return grouping.quantiles(readings.filter(reliable & (c(value) > 0)), [by], value, {name: 0.5})


def transition_signature(pairs: DataFrame, by: str, min_n: int = 5) -> DataFrame:
    """pairs(by, distance, jump, relation): mean and spread, with the share of groups below."""
    out = pairs.groupBy(by).agg(
        F.count("distance").alias("n"),
        F.count("jump").alias("n_jump"),
        F.avg("distance").alias("sound"),
        F.stddev_pop("distance").alias("sound_std"),
        F.avg("jump").alias("tempo"),
        F.stddev_pop("jump").alias("tempo_std"),
        F.avg(c("relation").isin(*SAFE_RELATIONS).cast("double")).alias("safe"),
    )
    out = out.filter((c("n") >= min_n) & (c("n_jump") >= min_n)).drop("n_jump")
    out = cut_lineage(out.withColumn("sound", rounded(c("sound"), 9)))  # a row per group, read by the total, the counts and the join
    total = out.agg(F.count(F.lit(1))).scalar()
    return share_below(out, [], "sound", "__below").withColumn("below", c("__below") / total).drop("__below")


def mix_signature(slots: DataFrame, vecs: DataFrame, by: str, order: str, bins: list[Column], min_n: int = 6) -> DataFrame:
    """slots(by, order, bpm, id), vecs(id, vec): eight shape features per mix with at least ``min_n`` vectored rows.

    Rows travel with the id of their vector; vectors are looked up once rows are in place, and for
    the sums once per (mix, vector).
    """
    from seguelake.functions import tempo
    from seguelake.operators.vectors import mean_vectors

    units = vecs.filter(c("vec").isNotNull()).select("id", vectors.unit(c("vec")).alias("vec"))
    d = slots.join(units.select("id"), "id", "left_semi")

    def step(df: DataFrame, window) -> DataFrame:
        w = window()
        out = df.withColumn("__nb", F.lead("bpm").over(w)).withColumn("__nid", F.lead("id").over(w))
        return out.withColumn(
            "jump", F.when((c("bpm") > 0) & (c("__nb") > 0), tempo.ratio_gap(c("bpm"), c("__nb")) * c("__nb"))
        ).drop("__nb")

    placed = grouping.windowed(d.select(by, order, "bpm", "id"), [by], [order], bins, 1, step)
    following = units.select(c("id").alias("__nid"), c("vec").alias("__nv"))
    near = placed.join(units, "id").join(following, "__nid", "left").withColumn("cos", vectors.dot(c("vec"), c("__nv"))).drop("vec", "__nv", "__nid", "id")
    near = cut_lineage(near)  # read by five aggregates
    known = F.when(c("bpm") > 0, c("bpm"))
    base = near.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("jump").alias("n_jump"),
        F.avg((c("jump") < 1.0).cast("double")).alias("locked"),
        F.min_by(known, F.when(known.isNotNull(), c(order))).alias("__b0"),
        F.max_by(known, F.when(known.isNotNull(), c(order))).alias("__b1"),
        F.count(known).alias("__nb"),
    )
    # sum of all pairwise dot products from the squared length of the summed vectors
    often = d.groupBy(by, "id").agg(F.count(F.lit(1)).alias("__k")).join(units, "id")
    means = mean_vectors(often.withColumn("vec", F.transform("vec", lambda x: x * c("__k"))), [by], "vec")
    spread = means.select(by, (vectors.dot(c("mean"), c("mean")) * c("n") * c("n")).alias("__sq"))
    out = base.filter((c("n") >= min_n) & (c("n_jump") >= 4)).join(spread, by)
    out = out.withColumn("palette", (c("__sq") - c("n")) / (c("n") * (c("n") - 1)))
    out = out.withColumn("drift", F.when(c("__nb") > 2, (c("__b1") - c("__b0")) / F.greatest(F.lit(1), c("__nb") - 1)).otherwise(0.0))
    for value, probs in (
        ("bpm", {"bpm_median": 0.5}),
        ("jump", {"jump_median": 0.5}),
        ("cos", {"cos_median": 0.5, "__q1": 0.25, "__q3": 0.75}),
    ):
        out = out.join(grouping.quantiles(near, [by], value, probs), by, "left")
    return out.withColumn("cos_iqr", c("__q3") - c("__q1")).select(
        by, "bpm_median", "jump_median", "locked", "cos_median", "cos_iqr", "palette", "drift", "n"
    )


def order_statistics(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Values at index floor(share * n) of the sorted group."""
    d = df.filter(c(value).isNotNull()).select(*by, c(value).alias("__v"))
    cells = d.groupBy(*by, "__v").agg(F.count(F.lit(1)).alias("__n"))
    binned = grouping.quantile_bins(cells, by, "__v") if grouping.large_groups(cells, by) is not None else cells.withColumn("__qbin", F.lit(0))
    ran = grouping.running(binned, by, ["__v"], [c("__qbin")], sums={"__run": c("__n")})
    sizes = d.groupBy(*by).agg(F.count(F.lit(1)).alias("__size"))
    joined = ran.join(sizes, by)
    aggs = []
    for n, p in shares.items():
        at = F.least(F.floor(F.lit(p) * c("__size")), c("__size") - 1)
        inside = (c("__run") > at) & (c("__run") - c("__n") <= at)
        aggs.append(F.max(F.when(inside, c("__v"))).alias(n))
    return joined.groupBy(*by).agg(*aggs)


def performer_facts(seams: DataFrame, tracks: DataFrame, by: str, min_full: int) -> DataFrame:
    """seams(by, fit, jump), tracks(by, track, bpm, energy): tempo range by index, fit share, medians of distinct tracks."""
    facts = seams.groupBy(by).agg(
        rounded(F.avg(c("fit").cast("double")) * 100, 1).alias("fit_pct"), F.count_if(c("jump").isNotNull()).alias("full")
    )
    distinct = tracks.groupBy(by, "track").agg(F.min("bpm").alias("bpm"), F.min("energy").alias("energy"))
    out = facts.join(order_statistics(distinct, [by], "bpm", {"bpm_p10": 0.1, "bpm_mid": 0.5, "bpm_p90": 0.9}), by)
    out = out.join(grouping.quantiles(seams, [by], "jump", {"jump_median": 0.5}), by, "left")
    out = out.join(grouping.quantiles(distinct, [by], "energy", {"energy_median": 0.5}), by, "left")
    for n in ("jump_median", "energy_median"):
        out = out.withColumn(n, F.when(c("full") >= min_full, c(n)))
    return out


def seam_profile(seams: DataFrame, length: str, status: str) -> DataFrame:
    """Quantiles of the blend length with its coverage, and the share per confirmation status."""
    shares = seams.agg(
        F.count(F.lit(1)).alias("n"),
        F.count(length).alias("n_length"),
        *[rounded(F.avg((c(status) == s).cast("double")) * 100, 1).alias(f"{s}_pct") for s in ("hand", "record", "unsure")],
    )
    q = grouping.quantiles(seams, [], length, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    packed = q.select(F.struct("q25", "q50", "q75"))
    return shares.withColumn("q", packed.scalar()).select("n", "n_length", "hand_pct", "record_pct", "unsure_pct", "q.q25", "q.q50", "q.q75")


def error_metrics(errors: DataFrame, value: str, limits=(0.1, 1.0, 2.0)) -> DataFrame:
    """Mean, median, p90 and max error with counts inside each limit and above the last."""
    base = errors.agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.max(value).alias("max"),
        *[F.count_if(c(value) <= x).alias("within_" + str(x).replace(".", "_")) for x in limits],
        F.count_if(c(value) > limits[-1]).alias("gross"),
    )
    q = grouping.quantiles(errors, [], value, {"median": 0.5, "p90": 0.9}).select(F.struct("median", "p90"))
    return base.withColumn("q", q.scalar()).select("*", "q.median", "q.p90").drop("q")


def topic_counts(comments: DataFrame, column: str, topics: dict[str, list[str]]) -> DataFrame:
    """Comments that contain any keyword of each topic."""
    low = F.lower(c(column))
    hit = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: low.contains(w))
    hits = F.array_compact(F.array(*[F.when(hit(words), t) for t, words in topics.items()]))
    return comments.select(F.explode(hits).alias("topic")).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


def catalog_summary(slots: DataFrame, mixes: DataFrame, adjacency: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: sizes of the catalogue tables, date range and number of issues."""
    s = slots.agg(F.count(F.lit(1)).alias("slots"), F.count_distinct("track").alias("tracks"), F.count_if("placeholder").alias("placeholders"))
    m = mixes.agg(
        F.count(F.lit(1)).alias("mixes"),
        F.count_distinct("dj").alias("performers"),
        F.date_format(F.min("day"), "yyyy-MM-dd").alias("first_day"),
        F.date_format(F.max("day"), "yyyy-MM-dd").alias("last_day"),
    )
    pack = m.select(F.struct("*")).scalar()
    return (
        s.withColumn("m", pack)
        .withColumn("adjacencies", adjacency.agg(F.count(F.lit(1))).scalar())
        .withColumn("issues", issues.agg(F.count(F.lit(1))).scalar())
        .select("slots", "tracks", "placeholders", "adjacencies", "issues", "m.*")
    )


def verdict_counts(verdicts: DataFrame, column: str, values: list[str]) -> DataFrame:
    return verdicts.agg(*[F.count_if(c(column) == v).alias(v) for v in values])
