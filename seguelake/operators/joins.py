"""Equi, as-of, interval, nearest and linkage joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seguelake import grouping
from seguelake.functions import text
from seguelake.session import cut_lineage

c = F.col


def attach_vectors(tracks: DataFrame, vecs: DataFrame, path: str, vec: str) -> DataFrame:
    """Left join on the normalised path; a present vector is kept; ``origin`` says which happened."""
    key = F.lower(text.unaccented(c(path)))
    right = vecs.select(key.alias("__key"), c(vec).alias("__new")).dropDuplicates(["__key"])
    out = tracks.withColumn("__key", key).join(right, "__key", "left")
    origin = F.when(c(vec).isNotNull(), "kept").when(c("__new").isNotNull(), "attached").otherwise("missing")
    return out.withColumn("origin", origin).withColumn(vec, F.coalesce(c(vec), c("__new"))).drop("__key", "__new")


def enrich_missing(tracks: DataFrame, lookup: DataFrame, key: str, fields: list[str], locked: dict[str, Column]) -> DataFrame:
    """Fill absent fields from ``lookup``; a locked field is never touched; ``found`` marks lookup hits."""
    right = lookup.select(key, *[c(f).alias(f"__{f}") for f in fields], F.lit(True).alias("__hit"))
    out = tracks.join(right, key, "left").withColumn("found", F.coalesce("__hit", F.lit(False)))
    for f in fields:
        open_ = ~locked[f] if f in locked else F.lit(True)
        out = out.withColumn(f, F.when(c(f).isNull() & open_, c(f"__{f}")).otherwise(c(f)))
    return out.drop("__hit", *[f"__{f}" for f in fields])


def exact_then_unique(left: DataFrame, right: DataFrame, exact: str, fallback: str, right_id: str) -> DataFrame:
    """Exact key first; else a fallback key that names exactly one right row; else unmatched."""
    by_exact = right.groupBy(exact).agg(F.max(right_id).alias("__exact"))
    by_name = (
        right.groupBy(fallback)
        .agg(F.count_distinct(right_id).alias("__n"), F.min(right_id).alias("__name"))
        .filter(c("__n") == 1)
        .drop("__n")
    )
    out = left.join(by_exact, exact, "left").join(by_name, fallback, "left")
    method = F.when(c("__exact").isNotNull(), "exact").when(c("__name").isNotNull(), "unique_fallback").otherwise("unmatched")
    return out.withColumn("method", method).withColumn("match", F.coalesce("__exact", "__name")).drop("__exact", "__name")


def clean_url(url: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"/+$", ""))


def link_with_confidence(lists: DataFrame, sets: DataFrame, known: DataFrame) -> DataFrame:
    """lists(list_id, url, artist, year), sets(set_id, url, artist, year), known(artist).

    Tier: equal address, else artist and year naming one set, else new; unknown artists are rejected.
    """
    a = lists.withColumn("__url", clean_url(c("url"))).withColumn("__who", text.compact_key(c("artist")))
    b = sets.withColumn("__url", clean_url(c("url"))).withColumn("__who", text.compact_key(c("artist")))
    by_url = b.groupBy("__url").agg(F.max("set_id").alias("__u"))
    by_who = b.groupBy("__who", "year").agg(F.count(F.lit(1)).alias("__n"), F.min("set_id").alias("__w")).filter(c("__n") == 1)
    who = known.select(text.compact_key(c("artist")).alias("__who"), F.lit(True).alias("__known")).distinct()
    out = a.join(by_url, "__url", "left").join(by_who.drop("__n"), ["__who", "year"], "left").join(who, "__who", "left")
    tier = (
        F.when(c("__u").isNotNull(), "url")
        .when(c("__known").isNull(), "rejected")
        .when(c("__w").isNotNull(), "artist_year")
        .otherwise("new")
    )
    target = F.when(tier == "url", c("__u")).when(tier == "artist_year", c("__w"))
    return out.select("list_id", tier.alias("tier"), target.alias("set_id"))


def record_keys(df: DataFrame, artist: str, title: str) -> DataFrame:
    """Distinct (artist tokens, title tokens) with the number of rows carrying them."""
    keyed = df.select(text.tokens(c(artist)).alias("artist"), text.title_tokens(c(title)).alias("title"))
    keyed = keyed.filter((F.size("artist") > 0) & (F.size("title") > 0))
    return keyed.groupBy("artist", "title").agg(F.count(F.lit(1)).alias("n"))


def record_linkage(library: DataFrame, releases: DataFrame) -> DataFrame:
    """Match distinct record keys (see ``record_keys``).

    Artists must share a token; titles are equal, or one contains the other and
    the extra words hold both a number and a word.  The shorter title's words are
    all in the longer one, so it is enough to look up its rarest word together
    with each artist token: no pair outside the answer's candidates is formed,
    and copies of a record are matched once.
    """
    rarity = (
        library.select(F.explode("title").alias("w"))
        .unionByName(releases.select(F.explode("title").alias("w")))
        .groupBy("w")
        .agg(F.count(F.lit(1)).alias("freq"))
    )

    def rare(df: DataFrame) -> DataFrame:
        words = df.select("artist", "title", "n", F.explode("title").alias("w")).join(rarity, "w")
        return words.groupBy("artist", "title", "n").agg(F.min_by("w", F.struct("freq", "w")).alias("w"))

    def keyed(df: DataFrame, side: str) -> DataFrame:
        flat = df.withColumn("who", F.explode("artist"))
        return flat.select("who", "w", *[c(x).alias(f"{x}_{side}") for x in ("artist", "title", "n")])

    def every(df: DataFrame) -> DataFrame:
        return df.withColumn("w", F.explode("title"))

    short_left = keyed(rare(library), "a").join(keyed(every(releases), "b"), ["who", "w"])
    short_right = keyed(every(library), "a").join(keyed(rare(releases), "b"), ["who", "w"])
    candidates = short_left.unionByName(short_right).drop("who", "w").distinct()
    extra = F.concat(F.array_except("title_b", "title_a"), F.array_except("title_a", "title_b"))
    inside = (F.size(F.array_except("title_a", "title_b")) == 0) | (F.size(F.array_except("title_b", "title_a")) == 0)
    digits = lambda w: w.rlike("^[0-9]+$")
    series = F.exists(extra, digits) & F.exists(extra, lambda w: ~digits(w))
    return candidates.filter(inside & ((F.size(extra) == 0) | series)).withColumn(
        "kind", F.when(F.size(extra) == 0, "same").otherwise("series")
    )


def fuzzy_containment(named: DataFrame, listed: DataFrame, by: str, threshold: float = 0.5) -> DataFrame:
    """named(by, nid, text), listed(by, pos, text): best overlap of word sets; ties take the earliest."""
    a = named.select(by, "nid", text.tokens(c("text"), 2).alias("wa"))
    b = listed.select(by, "pos", text.tokens(c("text"), 2).alias("wb"))
    fa = a.select(by, "nid", F.size("wa").alias("na"), F.explode("wa").alias("w"))
    fb = b.select(by, "pos", F.size("wb").alias("nb"), F.explode("wb").alias("w"))
    shared = fa.join(fb, [by, "w"]).groupBy(by, "nid", "pos", "na", "nb").agg(F.count(F.lit(1)).alias("k"))
    scored = shared.withColumn("score", c("k") / F.least("na", "nb"))
    best = scored.groupBy(by, "nid").agg(F.min_by(F.struct("pos", "score"), F.struct(-c("score"), c("pos"))).alias("x"))
    return best.select(by, "nid", "x.pos", "x.score").filter(c("score") >= threshold)


def occurrence_join(slots: DataFrame, reports: DataFrame, by: list[str], slot_order, report_order, slot_bins, report_bins):
    """k-th occurrence of an id on the left with its k-th report; returns (joined, orphan reports)."""
    left = grouping.position(slots, by, slot_order, slot_bins, "k")
    right = grouping.position(reports, by, report_order, report_bins, "k")
    return left.join(right, [*by, "k"], "left"), right.join(left, [*by, "k"], "left_anti")


def window_pairs(edges: DataFrame, windows: DataFrame, k: int = 3, conflict: float = 0.65) -> DataFrame:
    """Best k out-window x in-window pairs per edge; a side without its type offers all its windows."""

    def side(kind: str, s: str) -> DataFrame:
        has = grouping.attach(windows, ["track"], any_kind=F.bool_or(c("kind") == kind))
        kept = has.filter(~c("any_kind") | (c("kind") == kind))
        return kept.select(c("track").alias(s), *[c(x).alias(f"{x}_{s}") for x in ("start", "end", "score", "risk")])

    pairs = edges.join(side("mix_out", "a"), "a").join(side("mix_in", "b"), "b")
    risk = (F.coalesce("risk_a", F.lit(0.0)) + F.coalesce("risk_b", F.lit(0.0))) / 2
    scored = pairs.withColumn("pair_score", c("m") + c("score_a") + c("score_b") - conflict * risk)
    return grouping.first_rows(scored, ["a", "b"], [c("pair_score").desc(), "start_a", "start_b"], k, "rank")


def interval_values(frames: DataFrame, intervals: DataFrame, by: str, width: float) -> DataFrame:
    """Rows of ``frames(by, t, ..)`` inside the closed ``[start, end]`` of ``intervals(by, iid, ..)``.

    The equi key (group, time bin) spreads a large group over its bins.
    """
    cells = grouping.explode_bins(intervals, c("start"), c("end"), width)
    return frames.withColumn("__cell", F.floor(c("t") / width)).join(cells, [by, "__cell"]).filter(
        c("t").between(c("start"), c("end"))
    ).drop("__cell")


def interval_mean(frames: DataFrame, intervals: DataFrame, by: str, value: str, width: float) -> DataFrame:
    """Mean of ``value`` in each closed interval; an empty one takes the frame nearest its middle."""
    inside = interval_values(frames, intervals, by, width).groupBy("iid").agg(
        F.avg(value).alias("mean"), F.count(value).alias("n")
    )
    out = intervals.join(inside, "iid", "left")
    empty = out.filter(c("n").isNull()).select(by, "iid", ((c("start") + c("end")) / 2).alias("t"))
    near = nearest(empty, frames.select(by, "t", value), by, "t", width, {"near": value})
    return (
        out.join(near.select("iid", "near"), "iid", "left")
        .withColumn("mean", F.coalesce("mean", "near"))
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .drop("near")
    )


def _merged(events: DataFrame, marks: DataFrame, by: str, t: str, width: float, take: dict[str, str], reverse: bool) -> DataFrame:
    """Events with the last mark at or before (or first at or after) their time."""
    fields = [c(v).alias(n) for n, v in take.items()]
    left = events.withColumn("__mark", F.lit(None).cast(marks.select(F.struct(c(t).alias("t"), *fields)).schema[0].dataType))
    left = left.withColumn("__kind", F.lit(0 if reverse else 1)).withColumn("__tie", F.monotonically_increasing_id())
    right = marks.select(by, t, F.struct(c(t).alias("t"), *fields).alias("__mark"), F.lit(1 if reverse else 0).alias("__kind"))
    both = left.unionByName(right, allowMissingColumns=True)
    scanned = grouping.running(
        both, [by], [t, "__kind"], [F.floor(c(t) / width)], lasts={"__found": c("__mark")}, reverse=reverse
    )
    return scanned.filter(c("__kind") == (0 if reverse else 1)).drop("__mark", "__kind", "__tie")


def asof(events: DataFrame, marks: DataFrame, by: str, t: str, width: float, take: dict[str, str], first_if_before=True):
    """Last mark at or before each event; before the first mark, that first mark."""
    out = _merged(events, marks, by, t, width, take, reverse=False)
    if first_if_before:
        first = marks.groupBy(by).agg(F.min_by(F.struct(c(t).alias("t"), *[c(v).alias(n) for n, v in take.items()]), t).alias("__first"))
        out = out.join(first, by, "left").withColumn("__found", F.coalesce("__found", "__first")).drop("__first")
    return out.select("*", *[c("__found")[n].alias(n) for n in take], c("__found")["t"].alias("mark_t")).drop("__found")


def section_at(events: DataFrame, sections: DataFrame, by: str, t: str, width: float) -> DataFrame:
    """Label of the half-open section [start, end) that holds each event."""
    marks = sections.select(by, c("start").alias(t), "end", "label")
    out = asof(events, marks, by, t, width, {"__end": "end", "section": "label"}, first_if_before=False)
    label = F.when(c(t) < c("__end"), F.lower(F.trim("section")))
    return out.withColumn("section", label).drop("__end", "mark_t")


def nearest(events: DataFrame, marks: DataFrame, by: str, t: str, width: float, take: dict[str, str]) -> DataFrame:
    """Nearest mark on either side; an exact tie goes to the earlier one."""
    before = _merged(events, marks, by, t, width, take, reverse=False).withColumnRenamed("__found", "__before")
    both = _merged(before, marks, by, t, width, take, reverse=True).withColumnRenamed("__found", "__after")
    gap_b, gap_a = c(t) - c("__before")["t"], c("__after")["t"] - c(t)
    pick = F.when(c("__after").isNull() | (gap_b <= gap_a), c("__before")).otherwise(c("__after"))
    out = both.withColumn("__pick", pick)
    return out.select(
        "*", F.abs(c(t) - c("__pick")["t"]).alias("distance"), c("__pick")["t"].alias("mark_t"),
        *[c("__pick")[n].alias(n) for n in take],
    ).drop("__pick", "__before", "__after")


def cue_collisions(planned: DataFrame, existing: DataFrame, by: str, tolerance: float, action: str) -> DataFrame:
    """planned(by, pid, t, pad), existing(by, eid, t, pad): first existing cue close in time, else on the pad."""
    spans = planned.withColumn("start", c("t") - tolerance).withColumn("end", c("t") + tolerance).drop("t")
    close = interval_values(existing.select(by, "eid", "t"), spans, by, tolerance * 4).groupBy("pid").agg(F.min("eid").alias("dup"))
    pads = existing.groupBy(by, "pad").agg(F.min("eid").alias("on_pad"))
    out = planned.join(close, "pid", "left").join(pads, [by, "pad"], "left")
    dup_word = "replaced" if action == "replace" else "deduped"
    pad_word = {"skip": "skipped", "replace": "replaced", "merge": "relocated"}[action]
    resolution = F.when(c("dup").isNotNull(), dup_word).when(c("on_pad").isNotNull(), pad_word).otherwise("placed")
    return out.withColumn("resolution", resolution).withColumn("existing", F.coalesce("dup", "on_pad")).drop("dup", "on_pad")


def mentions(titles: DataFrame, names: DataFrame, min_chars: int = 7) -> DataFrame:
    """Longest known name in each text on word boundaries, and its place among that name's texts, newest first.

    titles(id, text), names(name).  Texts and names meet on a name's first two words (its only word
    where it has one); what meets is then compared in full, so names may be of any length and
    occur in any number of texts: ranks come from the whole table's order.
    """
    head = lambda ws: F.array_join(F.slice(ws, 1, 2), " ")
    keys = names.select(c("name"), text.words_key(c("name")).alias("gram")).filter(F.length("gram") + 2 >= min_chars)
    keys = cut_lineage(keys.groupBy("gram").agg(F.min("name").alias("name")).withColumn("head", head(F.split("gram", " "))))
    # written once, so that no expression below splits a text again for each of its words
    words = cut_lineage(titles.select("id", text.words_key(c("text")).alias("words")).withColumn("ws", F.split("words", " ")))
    pairs = F.zip_with("ws", F.slice("ws", F.lit(2), F.size("ws")), lambda a, b: F.when(b.isNotNull(), F.concat_ws(" ", a, b)))
    heads = F.array_distinct(F.array_compact(F.concat(pairs, "ws")))
    found = words.select("id", F.explode(heads).alias("head")).join(keys, "head").select("id", "gram", "name")
    padded = words.select("id", F.concat(F.lit(" "), c("words"), F.lit(" ")).alias("padded"))
    sure = found.join(padded, "id").filter(F.contains("padded", F.concat(F.lit(" "), c("gram"), F.lit(" "))))
    hits = sure.groupBy("id").agg(F.max_by("name", F.struct(F.length("gram"), "gram")).alias("name"))
    return grouping.numbered_within(hits, ["name"], [c("id").desc()], "rank")


def strict_history(mixes: DataFrame, slots: DataFrame, window_days: int) -> DataFrame:
    """Per mix: earlier mixes of its DJ, earlier mixes inside the day window, distinct earlier tracks.

    Only strictly earlier days count.  Everything is read off running counts per
    (dj, day), so no target is ever paired with each of its predecessors.
    """
    daily = mixes.groupBy("dj", "day").agg(F.count(F.lit(1)).alias("sets"))
    firsts = (
        slots.join(mixes.select("mix", "dj", "day"), "mix").groupBy("dj", "track").agg(F.min("day").alias("day"))
        .groupBy("dj", "day").agg(F.count(F.lit(1)).alias("fresh"))
    )
    ledger = daily.join(firsts, ["dj", "day"], "left").withColumn("fresh", F.coalesce("fresh", F.lit(0)))
    ledger = ledger.withColumn("t", F.unix_date("day"))
    year = [F.floor(c("t") / 366)]
    ran = grouping.running(ledger, ["dj"], ["t"], year, sums={"all_sets": c("sets"), "all_tracks": c("fresh")})
    ran = ran.withColumn("prior_sets", c("all_sets") - c("sets")).withColumn("prior_tracks", c("all_tracks") - c("fresh"))
    edge = ran.select("dj", (c("t") - window_days - 1).alias("t"), c("t").alias("own"))
    before = asof(edge, ran.select("dj", "t", "all_sets"), "dj", "t", 366.0, {"older": "all_sets"}, first_if_before=False)
    out = ran.join(before.select("dj", c("own").alias("t"), "older"), ["dj", "t"], "left")
    out = out.withColumn("window_sets", c("prior_sets") - F.coalesce("older", F.lit(0)))
    return mixes.select("mix", "dj", "day").join(out.select("dj", "day", "prior_sets", "prior_tracks", "window_sets"), ["dj", "day"])


def two_arm_compare(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Same pairs under two analyses: difference and whether the flag flipped."""
    joined = a.select(*keys, c("score").alias("score_a"), c("flag").alias("flag_a")).join(
        b.select(*keys, c("score").alias("score_b"), c("flag").alias("flag_b")), keys
    )
    return joined.withColumn("delta", c("score_b") - c("score_a")).withColumn("flipped", c("flag_a") != c("flag_b")).orderBy(
        F.abs("delta").desc(), *keys
    )


def coverage(required: DataFrame, available: DataFrame, key: str) -> DataFrame:
    """Counts of keys on both sides, missing and extra."""
    a = required.select(key).distinct().withColumn("r", F.lit(1))
    b = available.select(key).distinct().withColumn("v", F.lit(1))
    state = F.when(c("v").isNull(), "missing").when(c("r").isNull(), "extra").otherwise("covered")
    return a.join(b, key, "full").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def handle_resolution(artists: DataFrame, profiles: DataFrame, min_chars: int = 5) -> DataFrame:
    """artists(artist), profiles(order, name, handle, uploads): first profile whose name or handle is the same."""
    who = artists.select("artist", text.compact_key(c("artist")).alias("key")).filter(F.length("key") >= min_chars)
    by_key = (
        profiles.select("order", "handle", "uploads", F.explode(F.array_distinct(F.array(text.compact_key(c("name")), text.compact_key(c("handle"))))).alias("key"))
        .groupBy("key")
        .agg(F.min_by(F.struct("handle", "uploads"), "order").alias("p"))
    )
    out = who.join(by_key, "key")
    return out.select("artist", "p.handle", F.when(c("p.uploads") >= 2, "confirmed").otherwise("unsure").alias("certainty"))


def next_pick(observations: DataFrame, by: str, order: str, bins: list[Column]) -> DataFrame:
    """observations(by, order, selected, n_candidates): the next pick of the run leaves the candidate pool."""

    def step(df: DataFrame, window) -> DataFrame:
        w = window()
        following = F.when(F.lead(order).over(w) == c(order) + 1, F.lead("selected").over(w))
        return df.withColumn("next_selected", following)

    out = grouping.windowed(observations, [by], [order], bins, 1, step)
    return out.filter(c("next_selected").isNotNull()).withColumn("n_pool", c("n_candidates") - 1)
