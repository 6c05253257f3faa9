"""Mixing sources by temperature, realised as budgeted block permutations.

Source shares p become weights proportional to p^a.  The exponent a between 0 and
1 is bisected: towards a wanted entropy of the weights, or to the smallest a at
which no source is repeated more often than a limit.  A source with weight w gets
w x budget tokens: whole epochs of all its documents, then part of one more epoch.
In every epoch the source's documents lie in hashed blocks, blocks are permuted by
a hash of epoch and block, and documents inside a block by a hash of epoch and id;
the last epoch stops where the tokens are used up.

Only DataFrame functions are used.  A source is never gathered: running sums go
over the blocks of a source, and only the one block that a source's budget ends in
is ordered by document.

Nulls and odd cases: null sources form a source of their own; null and empty texts
have no tokens but move with their block; a source without tokens is taken once;
rows with equal ids share their place, so ties at the end of a budget are all taken
or all left; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seguelake.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
LEVELS, PASSES = 8, 5
BROADCAST_SOURCES = 20_000


def bisect(rows: DataFrame, accepted: Callable[[str], Column], low: float = 0.0, high: float = 1.0) -> float:
    """The smallest accepted exponent to 40 binary digits, where acceptance is monotone; ``high`` if none below is accepted.

    ``accepted`` gives an aggregate over ``rows`` from the name of the exponent's column.
    One pass tries all midpoints that eight steps of bisection could ask for.
    """
    for _ in range(PASSES):
        points = (1 << LEVELS) - 1
        grid = F.array(*[F.lit(low + (high - low) * (i + 1) / (points + 1)) for i in range(points)])
        tried = rows.withColumn("__a", F.explode(grid)).groupBy("__a").agg(accepted("__a").alias("ok"))
        first = tried.filter("ok").agg(F.min("__a").alias("a")).first().a
        last = tried.filter("NOT ok").agg(F.max("__a").alias("a")).first().a
        low, high = (last if last is not None else low), (first if first is not None else high)
    return high


def place_key(seed: int, epoch: Column, what: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(what.cast("string"), F.lit(""))))


def block_of(seed: int, doc_id: Column, blocks: Column) -> Column:
    number = F.conv(F.substring(place_key(seed, F.lit("block"), doc_id), 1, 8), 16, 10).cast("long")
    return number % blocks


def plan(docs: DataFrame, budget: float = 1.0, max_repeats: float | None = 1.25, entropy: float | None = None, block_tokens: int = 200_000, seed: int = 7) -> DataFrame:
    """One row per source: weight, epochs, blocks and where the last epoch ends.

    ``budget`` is in multiples of the corpus; ``entropy`` in multiples of its largest value.
    """
    tokens = F.regexp_count(F.coalesce(docs["text"], F.lit("")), F.lit(WORD)).cast("long")
    sized = cut_lineage(docs.select(docs["doc_id"].alias("doc_id"), docs["source"].alias("source"), tokens.alias("tokens")))
    shares = cut_lineage(sized.groupBy("source").agg(F.sum("tokens").alias("all_tokens")))
    total, sources = shares.agg(F.sum("all_tokens"), F.count(F.when(F.col("all_tokens") > 0, 1))).first()
    total = total or 0
    p = shares.filter("all_tokens > 0").select((F.col("all_tokens") / F.lit(float(total))).alias("p"))
    if not total:
        exponent = 1.0
    elif entropy is not None:
        # H = ln Z - (a / Z) sum p^a ln p falls as a grows
        z = lambda a: F.sum(F.pow("p", F.col(a)))
        exponent = bisect(p, lambda a: F.log(z(a)) - F.max(F.col(a)) * F.sum(F.pow("p", F.col(a)) * F.log("p")) / z(a) <= entropy * F.log(F.lit(float(sources))))
    else:
        exponent = bisect(p, lambda a: F.lit(budget) * F.pow(F.min("p"), F.max(F.col(a)) - 1) / F.sum(F.pow("p", F.col(a))) <= max_repeats)
    norm = p.agg(F.sum(F.pow("p", F.lit(exponent)))).first()[0] or 1.0
    share = F.col("all_tokens") / F.lit(float(total or 1))
    quotas = shares.withColumn("weight", F.when(F.col("all_tokens") > 0, F.pow(share, F.lit(exponent)) / F.lit(norm)).otherwise(0.0))
    quotas = quotas.withColumn("quota", F.when(F.col("all_tokens") > 0, F.floor(F.col("weight") * F.lit(budget * total))).otherwise(F.lit(0)).cast("long"))
    quotas = quotas.withColumns(
        {
            "blocks": F.greatest(F.lit(1), F.ceil(F.col("all_tokens") / F.lit(float(block_tokens)))).cast("long"),
            "epochs": F.when(F.col("all_tokens") > 0, F.floor(F.col("quota") / F.greatest("all_tokens", F.lit(1)))).otherwise(F.lit(1)).cast("long"),
        }
    ).withColumn("rest", F.when(F.col("all_tokens") > 0, F.col("quota") - F.col("epochs") * F.col("all_tokens")).otherwise(F.lit(0)))
    quotas = cut_lineage(quotas)
    mine = quotas.select(F.col("source").alias("q_source"), "blocks", "epochs", "rest")
    dealt = sized.join(_small(mine), sized["source"].eqNullSafe(mine["q_source"])).drop("q_source")
    dealt = dealt.withColumn("block", block_of(seed, F.col("doc_id"), F.col("blocks")))
    sums = dealt.groupBy("source", "block", "epochs", "rest").agg(F.sum("tokens").alias("block_sum")).withColumn("block_key", place_key(seed, F.col("epochs"), F.col("block")))
    line = Window.partitionBy("source").orderBy("block_key", "block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("through", F.sum("block_sum").over(line))
    ends = sums.filter("through > rest").groupBy("source").agg(F.min_by(F.struct("block", "block_key", (F.col("rest") - F.col("through") + F.col("block_sum")).alias("left")), F.struct("through", "block_key")).alias("end"))
    ends = cut_lineage(ends.select(F.col("source").alias("e_source"), "end"))
    inside = dealt.join(_small(ends), dealt["source"].eqNullSafe(ends["e_source"]) & (F.col("block") == F.col("end.block")))
    inside = inside.withColumn("doc_key", place_key(seed, F.col("epochs"), F.col("doc_id")))
    within = Window.partitionBy("source").orderBy("doc_key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    taken = inside.withColumn("through", F.sum("tokens").over(within)).filter(F.col("through") <= F.col("end.left"))
    last = taken.groupBy(F.col("source").alias("l_source")).agg(F.max("doc_key").alias("end_doc"))
    out = quotas.join(ends, quotas["source"].eqNullSafe(ends["e_source"]), "left").join(last, quotas["source"].eqNullSafe(last["l_source"]), "left")
    return cut_lineage(out.select(
        "source", "weight", "quota", "blocks", "epochs", F.col("end.block_key").alias("end_block"), F.coalesce("end_doc", F.lit("")).alias("end_doc")
    ))


def _small(rows: DataFrame) -> DataFrame:
    """Broadcast a table of one row per source while it is known to be small."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_SOURCES else rows


def realise(docs: DataFrame, plan: DataFrame, seed: int = 7) -> DataFrame:
    """The chosen document rows, once per epoch, with ``epoch``, ``block``, ``block_key`` and ``doc_key``."""
    taken = {"epoch", "block", "block_key", "doc_key"} & set(docs.columns)
    if taken:
        raise ValueError(f"columns {sorted(taken)} are added here; rename them first")
    mine = plan.select(F.struct("source", "blocks", "epochs", "end_block", "end_doc").alias("__plan"))
    rows = docs.join(_small(mine), docs["source"].eqNullSafe(F.col("__plan.source")))
    rows = rows.withColumn("block", block_of(seed, docs["doc_id"], F.col("__plan.blocks")))
    last = F.struct(place_key(seed, F.col("__plan.epochs"), F.col("block")), place_key(seed, F.col("__plan.epochs"), docs["doc_id"]))
    # a source whose budget ends on an epoch's border has rest 0: its first block already exceeds it, and no document fits
    inside = F.col("__plan.end_block").isNotNull() & (last <= F.struct("__plan.end_block", "__plan.end_doc"))
    copies = F.col("__plan.epochs") + inside.cast("long")
    rows = rows.withColumn("epoch", F.explode(F.when(copies > 0, F.sequence(F.lit(0).cast("long"), copies - 1)).otherwise(F.array().cast("array<bigint>"))))
    return rows.withColumns({"block_key": place_key(seed, F.col("epoch"), F.col("block")), "doc_key": place_key(seed, F.col("epoch"), F.col("doc_id"))}).drop("__plan")


def mix_sources(docs: DataFrame, seed: int = 7, **options) -> DataFrame:
    """The documents in their mixed numbers, with their own columns only."""
    renamed = docs.select("doc_id", "source", F.struct(*docs.columns).alias("__own"))
    return realise(renamed, plan(docs, seed=seed, **options), seed).select("__own.*")
