"""Unions, set algebra and duplicate handling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seguelake.functions import hashes

c = F.col


def union_sources(sources: dict[str, DataFrame]) -> DataFrame:
    parts = [d.withColumn("source", F.lit(n)) for n, d in sources.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def dedupe_by_content(df: DataFrame, content: Column, order: str) -> tuple[DataFrame, DataFrame]:
    """(kept rows, removed-to-kept map); rows with an unknown hash never merge."""
    keyed = df.withColumn("__hash", content)
    firsts = keyed.filter(c("__hash").isNotNull()).groupBy("__hash").agg(F.min(order).alias("kept"))
    mapped = keyed.join(firsts, "__hash", "left").withColumn("kept", F.coalesce("kept", order))
    kept = mapped.filter(c("kept") == c(order)).drop("__hash", "kept")
    return kept, mapped.filter(c("kept") != c(order)).select(c(order).alias("removed"), "kept")


def merge_ranked(df: DataFrame, key: Column, rank: list[Column], order: str) -> DataFrame:
    """Best row per key by ``rank`` (largest wins), at the position of the key's first row, with a copy count."""
    best = F.max_by(F.struct(*df.columns), F.struct(*rank, -c(order)))
    grouped = df.withColumn("__key", key).groupBy("__key").agg(
        best.alias("b"), F.min(order).alias("place"), F.count(F.lit(1)).alias("copies")
    )
    return grouped.select("b.*", "place", "copies")


def credit_dedup(credits: DataFrame, key: list[str], facts: list[str]) -> DataFrame:
    """One row per key; ``conflict`` where repeated credits disagree."""
    fact = F.struct(*facts)
    out = credits.groupBy(*key).agg(
        F.count(F.lit(1)).alias("copies"), F.count_distinct(fact).alias("versions"), F.min(fact).alias("f")
    )
    return out.select(*key, "copies", (c("versions") > 1).alias("conflict"), "f.*")


def twin_sequences(slots: DataFrame, by: str, order: str, item: str) -> DataFrame:
    """Groups with the same ordered content keep the smallest id.

    Content is compared through order-free sums of per-row hashes of (order,
    item), two independent 64-bit ones and the length, so no sequence is ever
    gathered into one row.
    """
    h1 = F.xxhash64(F.lit(1), c(order), c(item)).cast("decimal(38,0)")
    h2 = F.xxhash64(F.lit(2), c(order), c(item)).cast("decimal(38,0)")
    prints = slots.groupBy(by).agg(F.sum(h1).alias("s1"), F.sum(h2).alias("s2"), F.count(F.lit(1)).alias("n"))
    keepers = prints.groupBy("s1", "s2", "n").agg(F.min(by).alias("keeper"))
    return prints.join(keepers, ["s1", "s2", "n"]).select(by, "keeper", (c(by) == c("keeper")).alias("kept"))


def content_hash(*parts: Column) -> Column:
    return hashes.content(*parts)
