"""Histories that share their members.

The items of a group lie in order in chunks of fixed width, so what is stored is linear in
the items.  A target holds one reference: its group and a range of places.  Members are
listed by joining references with the chunks they touch; a target never has a copy of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seguelake import grouping
from seguelake.operators.joins import strict_history

c = F.col
WIDTH = 256


def chunked(items: DataFrame, by: list[str], order: list[Column], payload: list[str], width: int = WIDTH) -> DataFrame:
    """(by, chunk, members): each group in order, ``width`` items to a row; a member has its 0-based ``place``."""
    placed = grouping.numbered_within(items.select(*dict.fromkeys([*by, *payload]), F.struct(*order).alias("__order")), by, [c("__order").asc()], "__at")
    member = F.struct((c("__at") - 1).alias("place"), *payload)
    chunk = F.floor((c("__at") - 1) / width)
    return placed.groupBy(*by, chunk.alias("chunk")).agg(F.array_sort(F.collect_list(member)).alias("members"))  # at most ``width``


def members(references: DataFrame, chunks: DataFrame, by: list[str], width: int = WIDTH) -> DataFrame:
    """references(by, first, last, ...): a row per place from ``first`` up to but not including ``last``, with ``member``."""
    touched = F.sequence(F.floor(c("first") / width), F.floor((c("last") - 1) / width))
    asked = references.filter(c("last") > c("first")).withColumn("chunk", F.explode(touched))
    keyed = chunks.select(*[c(b).alias(f"__k_{b}") for b in by], c("chunk").alias("__chunk"), "members")
    same = c("chunk") == c("__chunk")
    for b in by:
        same = same & c(b).eqNullSafe(c(f"__k_{b}"))
    inside = F.filter("members", lambda m: (m["place"] >= c("first")) & (m["place"] < c("last")))
    return asked.join(keyed, same).withColumn("member", F.explode(inside)).drop("chunk", "__chunk", "members", *[f"__k_{b}" for b in by])


def prior_sets(mixes: DataFrame, slots: DataFrame, window_days: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(references, chunks) of the earlier sets of each mix's DJ: strictly earlier days, at most ``window_days`` before."""
    counted = strict_history(mixes, slots, 0 if window_days is None else window_days)
    first = F.lit(0).cast("long") if window_days is None else c("prior_sets") - c("window_sets")
    references = counted.select("mix", "dj", "day", first.alias("first"), c("prior_sets").alias("last"))
    return references, chunked(mixes.select("dj", "day", c("mix").alias("prior_mix")), ["dj"], [c("day"), c("prior_mix")], ["prior_mix", "day"])


def observation_references(observations: DataFrame, by: list[str]) -> DataFrame:
    """observations(by, n_history, n_candidates, ...): one reference for the history and one for the candidates of each pick."""
    sides = F.array(
        F.struct(F.lit("history").alias("role"), F.lit(0).cast("long").alias("first"), c("n_history").cast("long").alias("last")),
        F.struct(F.lit("candidate").alias("role"), c("n_history").cast("long").alias("first"), (c("n_history") + c("n_candidates")).cast("long").alias("last")),
    )
    return observations.withColumn("__side", F.explode(sides)).select(*observations.columns, "__side.*")
