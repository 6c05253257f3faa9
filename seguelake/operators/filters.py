"""Row filters with their reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seguelake import grouping
from seguelake.functions import tempo, text, vectors
from seguelake.functions.numeric import rounded

c = F.col


def filter_library(tracks, search: str | None = None, key: str | None = None, low=None, high=None, fields=("title", "style")):
    """Substring over the text fields, exact key, closed tempo window; an unknown tempo counts as 0."""
    out = tracks
    if search:
        out = out.filter(F.contains(F.lower(F.concat_ws(" ", *fields)), F.lit(search.lower())))
    if key:
        out = out.filter(c("camelot") == key)
    known = F.coalesce(c("bpm"), F.lit(0.0))
    if low is not None:
        out = out.filter(known >= low)
    if high is not None:
        out = out.filter(known <= high)
    return out


def style_label(value: Column) -> Column:
    label = F.regexp_replace(F.lower(F.trim(value)), r"\s+", "-")
    return F.when(label != "", label)


def style_matches(tracks: DataFrame, taxonomy: DataFrame, preferred: list[str]) -> DataFrame:
    """Whole-name match on canonical style names.

    taxonomy(alias, canon); a tag outside it stands for itself, a missing tag never matches.
    """
    tagged = tracks.withColumn("label", style_label(c("style")))
    known = taxonomy.select(style_label(c("alias")).alias("label"), style_label(c("canon")).alias("__canon"))
    out = tagged.join(known.dropDuplicates(["label"]), "label", "left")
    out = out.withColumn("canon", F.coalesce("__canon", "label")).drop("__canon")
    wanted = [p.strip().lower() for p in preferred if p.strip()]
    hit = c("canon").isin(*wanted) if wanted else F.lit(True)
    return out.withColumn("matches", F.coalesce(c("label").isNotNull() & hit, F.lit(False)))


def quality_core(mixes: DataFrame, slots: DataFrame, families: dict[str, str], tag: str, min_tracks: int) -> DataFrame:
    """Mixes with enough identified tracks, and the first tag family that matches."""
    named = slots.filter(c("track").isNotNull()).groupBy("mix").agg(F.count(F.lit(1)).alias("n_tracks"))
    family = F.lit("other")
    for name, pattern in reversed(families.items()):
        family = F.when(F.lower(c(tag)).rlike(pattern), name).otherwise(family)
    return mixes.join(named.filter(c("n_tracks") >= min_tracks), "mix").withColumn("family", family)


def qualify_reason(min_rate: float, need_grid: bool = True) -> Column:
    """First failing rule on (identity, aligned, matched, match_rate, cost, reliable)."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    grid = F.lit(need_grid) & ~F.coalesce(c("reliable"), F.lit(False))
    return (
        F.when(c("identity").isNull(), "missing_track_identity")
        .when(~F.coalesce(c("aligned"), F.lit(False)), "missing_alignment")
        .when(~F.coalesce(c("matched"), F.lit(False)), "not_matched")
        .when(~finite(c("match_rate")), "invalid_match_rate")
        .when(c("match_rate") < min_rate, "low_match_rate")
        .when(~finite(c("cost")), "invalid_alignment_cost")
        .when(grid, "unreliable_beatgrid")
        .otherwise("accepted")
    )


def filter_funnel(df: DataFrame, steps: list[tuple[str, Column]], distinct: dict[str, Column]) -> DataFrame:
    """Rows, percent of all rows and distinct keys left after each step, in one pass."""
    kept, exprs = F.lit(True), []
    for i, (_, cond) in enumerate(steps):
        kept = kept & F.coalesce(cond, F.lit(False))
        exprs.append(kept.alias(f"__s{i}"))
    flagged = df.select(*[e.alias(f"__d_{n}") for n, e in distinct.items()], *exprs)
    reached = flagged.withColumn("__upto", sum((c(f"__s{i}").cast("int") for i in range(len(steps))), F.lit(0)))
    levels = reached.withColumn("step", F.explode(F.sequence(F.lit(0), c("__upto"))))
    names = F.array(F.lit("all"), *[F.lit(n) for n, _ in steps])
    counted = levels.groupBy("step").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_distinct(f"__d_{n}").alias(n) for n in distinct]
    )
    total = flagged.agg(F.count(F.lit(1))).scalar()
    return counted.select(
        F.get(names, c("step")).alias("step"), "n", rounded(c("n") * 100.0 / total, 1).alias("pct"), *distinct
    )


def non_music(df: DataFrame, column: str, patterns: list[str]) -> DataFrame:
    return df.filter(~F.lower(c(column)).rlike("|".join(f"(?:{p})" for p in patterns)))


def event_membership(df: DataFrame, title: str, description: str, rules: list[tuple], refused: str) -> DataFrame:
    """First rule (event, pattern, title only?) that hits; promotional titles are refused."""
    both = F.concat_ws(" ", title, description)
    event = F.lit(None).cast("string")
    for name, pattern, title_only in reversed(rules):
        event = F.when((c(title) if title_only else both).rlike(pattern), name).otherwise(event)
    return df.withColumn("event", F.when(~c(title).rlike(refused), event)).filter(c("event").isNotNull())


def tempo_tier(bpm: Column, target: Column, previous: Column, tiers=(1.0, 2.0, 4.0, 6.0), descent: float = 0.5) -> Column:
    """Smallest tolerance in percent that admits the tempo; null when none does or it falls below the previous one."""
    variant = tempo.nearest_variant(target, bpm)
    falls = previous.isNotNull() & (variant < previous - descent)
    tier = F.when(bpm.isNull(), tiers[0]).when(falls, None)
    for t in tiers:
        tier = tier.when(F.abs(variant - target) <= target * t / 100.0, t)
    return tier


def tempo_band(pool: DataFrame, by: str, tiers=(1.0, 2.0, 4.0, 6.0), descent: float = 0.5) -> DataFrame:
    """pool(req, .., bpm, target, previous): rows of the first tolerance that has any; all rows when none has."""
    tier = tempo_tier(c("bpm"), c("target"), c("previous"), tiers, descent)
    marked = grouping.attach(pool.withColumn("tier", tier), [by], best=F.min("tier"))
    return marked.filter(c("best").isNull() | (c("tier") <= c("best"))).withColumn("band", c("best")).drop("tier", "best")


def centroid(vecs: DataFrame, vec: str, min_n: int = 20) -> DataFrame:
    """One row with the mean vector, null below ``min_n`` vectors."""
    from seguelake.operators.vectors import mean_vectors

    return mean_vectors(vecs, [], vec).select(F.when(c("n") >= min_n, c("mean")).alias("mean"))


def sound_sieve(pool: DataFrame, anchor: DataFrame, required: Column, need: int, share: float = 0.2) -> DataFrame:
    """Nearest share of the vectored pool to the anchor, plus required rows.

    Both sides are centred on the pool mean when there are enough vectors.  If
    fewer than ``need`` rows would remain, the whole pool is kept.
    """
    mean = centroid(pool.filter(c("vec").isNotNull()), "vec")
    d = pool.withColumn("__mean", mean.scalar()).withColumn("__anchor", anchor.scalar())
    shift = lambda v: F.when(c("__mean").isNull(), v).otherwise(vectors.minus(v, c("__mean")))
    d = d.withColumn("closeness", vectors.cosine(shift(c("vec")), shift(c("__anchor")))).drop("__mean", "__anchor")
    d = d.withColumn("__far", -F.coalesce(c("closeness"), F.lit(-2.0))).withColumn("__req", required)
    placed = grouping.position(d, [], ["__far", "id"], [F.floor(c("__far") * 1000)], "__pos")
    known = pool.filter(c("vec").isNotNull()).agg(F.greatest(F.bround(F.count(F.lit(1)) * share), F.lit(1)).cast("long"))
    keep = (c("closeness").isNotNull() & (c("__pos") <= known.scalar())) | c("__req")
    marked = placed.withColumn("__keep", keep)
    left = marked.agg(F.sum(c("__keep").cast("long"))).scalar()
    return marked.filter(c("__keep") | (left < need)).drop("__far", "__req", "__pos", "__keep")


def row_identity(artist: Column, title: Column, list_id: Column, pos: Column) -> Column:
    """Track key; a placeholder title gets a key of its own so it never merges."""
    own = F.concat_ws(":", F.lit("row"), list_id.cast("string"), pos.cast("string"))
    return F.when(text.is_placeholder(title), own).otherwise(F.concat_ws("|", text.compact_key(artist), text.compact_key(title)))


def three_valued_presence(sets: DataFrame, who: str, described: Column, in_slot: Column, since: Column) -> DataFrame:
    """seen, described but never seen, or not described, per artist."""
    live = sets.filter(since)
    grouped = live.groupBy(who).agg(
        F.bool_or(F.coalesce(in_slot, F.lit(False))).alias("__seen"),
        F.bool_or(F.coalesce(described, F.lit(False))).alias("__told"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(described).alias("n_described"),
    )
    state = F.when(c("__seen"), "seen").when(c("__told"), "never_in_slot").otherwise("not_described")
    return grouped.select(who, state.alias("state"), "n", "n_described")


def sentinel_comments(comments: DataFrame, durations: DataFrame, by: str, pattern: str, slack: float = 1.02) -> DataFrame:
    """Comments inside the recording that name a track; a bare ID is kept."""
    named = (F.upper(F.trim("text")) == "ID") | F.coalesce(c("text").rlike(pattern), F.lit(False))
    inside = c("duration").isNull() | (c("t") <= c("duration") * slack)
    return comments.join(durations, by, "left").filter(inside & named).drop("duration")


def suspicious_files(files: DataFrame, path: str, seconds: str, low: float, high: float, stem: str, folder: str) -> DataFrame:
    """Why a file is set aside; an unknown duration passes."""
    reason = (
        F.when(F.lower(c(path)).rlike(stem), "stem_file")
        .when(F.lower(c(path)).rlike(folder), "recording_folder")
        .when(c(seconds) < low, "too_short")
        .when(c(seconds) > high, "too_long")
    )
    return files.withColumn("reason", reason).filter(c("reason").isNotNull())
