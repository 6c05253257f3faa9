"""Neighbouring and candidate pairs, and their distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seguelake import grouping
from seguelake.functions import hashes, tempo
from seguelake.functions.numeric import rounded


def _neighbours(slots: DataFrame, by: str, order: str, item: str, bins: list[Column]) -> DataFrame:
    def step(df: DataFrame, window) -> DataFrame:
        w = window()
        return df.select("*", F.lead(item).over(w).alias("b"), F.lead(order).over(w).alias("__next"))

    return grouping.windowed(slots, [by], [order], bins, 1, step)


def adjacency_pairs(slots: DataFrame, by: str, order: str, item: str, bins: list[Column]) -> DataFrame:
    """Strict neighbours.  A missing position or item breaks the pair; an item never pairs with itself."""
    near = _neighbours(slots, by, order, item, bins).withColumnRenamed(item, "a")
    return near.filter((F.col("__next") == F.col(order) + 1) & (F.col("a") != F.col("b"))).drop("__next")


def adjacency_audit(slots: DataFrame, by: str, order: str, item: str, bins: list[Column]) -> DataFrame:
    """How many neighbours were kept, were the same item, or had a gap."""
    near = _neighbours(slots, by, order, item, bins).filter(F.col("__next").isNotNull())
    strict = F.col("__next") == F.col(order) + 1
    named = F.col(item).isNotNull() & F.col("b").isNotNull()
    kind = (
        F.when(~strict, "gap").when(~named, "missing_item").when(F.col(item) == F.col("b"), "same_item").otherwise("pair")
    )
    return near.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def with_track_features(pairs: DataFrame, tracks: DataFrame, columns: list[str], key: str = "track") -> DataFrame:
    """Attach ``<col>_a`` and ``<col>_b`` for both ends of each pair."""
    out = pairs
    for side in ("a", "b"):
        part = tracks.select(F.col(key).alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns])
        out = out.join(part, side)
    return out


def chance_pairs(slots: DataFrame, pairs: DataFrame, by: str, order: str, item: str, seed: int) -> DataFrame:
    """For each real pair a random pair of two different positions of the same group.

    ``order`` must be 1..n.  Both positions come from a hash of the pair, so the
    draw is repeatable and needs two equi joins instead of all pairs.
    """
    sizes = slots.groupBy(by).agg(F.max(order).alias("__n"))
    draw = hashes.seeded(seed, F.col(by), F.col(order))

    def part(start: int) -> Column:
        return F.conv(F.substring(draw, start, 8), 16, 10).cast("long")

    first = part(1) % F.col("__n") + 1
    second = (F.col("__p1") + part(9) % (F.col("__n") - 1)) % F.col("__n") + 1
    drawn = (
        pairs.select(by, order)
        .join(sizes, by)
        .filter(F.col("__n") >= 2)
        .withColumn("__p1", first)
        .withColumn("__p2", second)
    )
    for name, at in (("a", "__p1"), ("b", "__p2")):
        side = slots.select(F.col(by), F.col(order).alias(at), F.col(item).alias(name))
        drawn = drawn.join(side, [by, at])
    return drawn.select(by, order, "a", "b")


def bucket_distribution(df: DataFrame, kinds: list[str], digits: int = 1) -> DataFrame:
    """Rows and percent per bucket for several bucket columns in one pass.

    The window only sees one row per bucket.
    """
    long = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("bucket")) for k in kinds])).alias("x")).select("x.*")
    counts = long.filter(F.col("bucket").isNotNull()).groupBy("kind", "bucket").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("kind"))
    return counts.withColumn("pct", rounded(F.col("n") / total * 100.0, digits))


def preference_lift(real: DataFrame, chance: DataFrame, floor: float = 0.1, low: float = 0.4, high: float = 2.0) -> DataFrame:
    """Observed over expected percent per bucket, floored and clamped."""
    joined = real.select("kind", "bucket", F.col("pct").alias("real_pct")).join(
        chance.select("kind", "bucket", F.col("pct").alias("chance_pct")), ["kind", "bucket"], "full"
    )
    ratio = F.coalesce("real_pct", F.lit(floor)) / F.greatest(F.coalesce("chance_pct", F.lit(floor)), F.lit(floor))
    return joined.withColumn("lift", F.least(F.greatest(ratio, F.lit(low)), F.lit(high)))


def prior_lift(pairs: DataFrame, lifts: DataFrame, keys: list[str], low: float = 0.4, high: float = 2.0) -> DataFrame:
    """Product of the lifts of several bucket columns; a missing one counts as 1.

    ``lifts`` has (kind, bucket, lift): one row per bucket, a dozen in all.
    """
    entry = F.struct(F.concat_ws("/", "kind", "bucket"), "lift")
    table = lifts.agg(F.map_from_entries(F.collect_list(entry)))
    out = pairs.withColumn("__lifts", table.scalar())
    value = F.lit(1.0)
    for k in keys:
        value = value * F.coalesce(F.try_element_at("__lifts", F.concat(F.lit(f"{k}/"), F.col(k))), F.lit(1.0))
    return out.withColumn("lift", F.least(F.greatest(value, F.lit(low)), F.lit(high))).drop("__lifts")


def transition_deltas(slots: DataFrame, by: str, order: str, values: list[str], bins: list[Column]) -> DataFrame:
    """Signed change of each value from the previous row of the group, and percent of the previous."""

    def step(df: DataFrame, window) -> DataFrame:
        w = window()
        out = df
        for v in values:
            before = F.lag(v).over(w)
            out = out.withColumn(f"{v}_step", F.col(v) - before).withColumn(
                f"{v}_pct", F.when(before != 0, (F.col(v) - before) / before * 100.0)
            )
        return out

    return grouping.windowed(slots, [by], [order], bins, 1, step)


def candidate_pairs(
    requests: DataFrame, pool: DataFrame, history: DataFrame, tolerance: float = 0.06, per_bin: int = 16, facts: list[str] | None = None, traits: list[str] | None = None
) -> DataFrame:
    """Candidates for each request: same style and a tempo within ``tolerance`` after octave folding.

    requests(req, track, style, bpm), pool(track, style, bpm), history(req, track);
    ``facts`` names further columns of requests and ``traits`` of the pool to pass on.
    The tempo condition becomes an equi join on log-tempo bins of the tolerance
    width; each request looks into its own and the two adjacent bins, so only
    pairs that can qualify are formed.  Requests are spread over ``per_bin`` salts
    so that one crowded bin is shared by many tasks; the pool, the smaller side, has a
    copy for each.  A request carries the part of its history that lies in the bin,
    so the pairs themselves are never shuffled.
    """
    width = F.lit(-2.0) * F.log2(F.lit(1.0 - tolerance))
    count = F.floor(F.lit(1.0) / width).cast("int")
    phase = lambda c: F.log2(c) - F.floor(F.log2(c))
    cell = lambda c: F.least(F.floor(phase(c) * count), count - 1)
    facts, traits = facts or [], traits or []
    placed = pool.filter(F.col("bpm") > 0).select(
        F.col("track").alias("b"), "style", F.col("bpm").alias("bpm_b"), cell(F.col("bpm")).alias("cell"), *traits
    )
    seen = (
        history.select("req", F.col("track").alias("b")).join(placed.select("b", "style", "cell"), "b")
        .groupBy("req", "style", "cell").agg(F.collect_set("b").alias("__seen"))
    )
    look = F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.pmod(cell(F.col("bpm")) + d, count)))
    asks = (
        requests.filter(F.col("bpm") > 0)
        .select("req", F.col("track").alias("a"), "style", F.col("bpm").alias("bpm_a"), F.explode(look).alias("cell"), *facts)
        .join(seen, ["req", "style", "cell"], "left")
        .withColumn("salt", F.pmod(F.xxhash64("req", "a"), F.lit(per_bin)))
    )
    # few bytes, much work: a fixed number of partitions keeps them from being merged by size
    context = requests.sparkSession.sparkContext
    parts = max(int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * context.defaultParallelism)
    asks = asks.repartition(parts, "style", "cell", "salt")
    copies = placed.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(per_bin - 1).cast("long"))))
    # the copies look small to a planner that knows file sizes only; hashed per task, they never pass the driver
    near = asks.join(copies.hint("shuffle_hash"), ["style", "cell", "salt"]).filter(
        (F.col("a") != F.col("b")) & (tempo.relative_distance(F.col("bpm_a"), F.col("bpm_b")) <= tolerance)
    )
    fresh = near.filter(F.col("__seen").isNull() | ~F.array_contains("__seen", F.col("b")))
    return fresh.select("req", "a", "b", "bpm_a", "bpm_b", *facts, *traits)
