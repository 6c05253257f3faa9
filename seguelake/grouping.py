"""Ordered work inside groups of any size.

A plain window puts one whole group into one task.  Every helper here first
probes the group sizes (one column-pruned count).  Groups up to the limit use
the plain window; larger ones are split by ``bins``, a coarsening of the sort
order, and the pieces are stitched together through a small per-bin table.
Both ways give the same rows, so the probe only decides how the work is spread.

``order`` holds column names, all ascending and unique together within a group.
``bins`` holds columns that never decrease along ``order``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seguelake.session import cut_lineage

LIMIT_SETTING = "seguelake.hotGroupRows"
DEFAULT_LIMIT = 1_000_000
QUANTILE_BINS = 256
ARRAY_ROWS = 256
_probes: dict[tuple, bool] = {}


def _limit(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(LIMIT_SETTING, str(DEFAULT_LIMIT)))


def group_limit(df: DataFrame) -> int:
    """Rows of a group that one task may hold."""
    return _limit(df)


def row_limit(df: DataFrame) -> int:
    """Rows of a group that may stand in one array, where work grows with their square."""
    return min(_limit(df), ARRAY_ROWS)


def large_groups(df: DataFrame, by: Sequence[str], limit: int | None = None) -> DataFrame | None:
    """Keys of groups above the limit, or None.  At most rows / limit keys exist."""
    limit = limit or _limit(df)
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")) if by else df.agg(F.count(F.lit(1)).alias("__n"))
    keys = sizes.filter(F.col("__n") > limit)
    # a remembered probe can only be slower, never wrong: both ways are exact
    token = (df.sparkSession.sparkContext.applicationId, df.semanticHash(), tuple(by), limit)
    if token not in _probes:
        _probes[token] = not keys.isEmpty()
    if not _probes[token]:
        return None
    return keys.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(by)])


def _same_key(df: DataFrame, by: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [df[k].eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(by)])


def by_size(
    df: DataFrame,
    by: Sequence[str],
    plain: Callable[[DataFrame], DataFrame],
    spread: Callable[[DataFrame], DataFrame],
    limit: int | None = None,
) -> DataFrame:
    """``plain`` on groups within the limit and ``spread`` on the others."""
    keys = large_groups(df, by, limit)
    if keys is None:
        return plain(df)
    # several branches read the input from here on: write it once instead of deriving it again for each
    df = cut_lineage(df)
    if not by:
        return spread(df)
    keys = large_groups(df, by, limit)
    if limit is None:
        keys = F.broadcast(keys)
    cond = _same_key(df, by)
    small = plain(df.join(keys, cond, "left_anti"))
    return small.unionByName(spread(df.join(keys, cond, "left_semi")))


def _join_back(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    renamed = right.select(*[F.col(c).alias(f"__j_{c}") if c in on else F.col(c) for c in right.columns])
    cond = reduce(lambda a, b: a & b, [left[c].eqNullSafe(renamed[f"__j_{c}"]) for c in on])
    return left.join(renamed, cond, "left").drop(*[f"__j_{c}" for c in on])


def _spread_position(part: DataFrame, by: list[str], order: Sequence[str], bins: Sequence[Column], name: str) -> DataFrame:
    """Row numbers from per-bin numbers and the sizes of the earlier bins."""
    part = part.withColumn("__bin", F.struct(*bins))
    before = Window.partitionBy(*by).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        part.groupBy(*by, "__bin")
        .agg(F.count(F.lit(1)).alias("__c"))
        .select(*by, "__bin", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__off"))
    )
    inner = Window.partitionBy(*by, "__bin").orderBy(*order)
    ranked = part.withColumn("__r", F.row_number().over(inner))
    return (
        _join_back(ranked, offsets, [*by, "__bin"])
        .withColumn(name, (F.col("__r") + F.col("__off")).cast("long"))
        .drop("__bin", "__r", "__off")
    )


def position(
    df: DataFrame, by: Sequence[str], order: Sequence[str], bins: Sequence[Column], name: str = "position"
) -> DataFrame:
    """1-based row number per group."""
    by = list(by)

    def plain(part: DataFrame) -> DataFrame:
        return part.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))

    return by_size(df, by, plain, lambda part: _spread_position(part, by, order, bins, name))


def windowed(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    bins: Sequence[Column],
    radius: int,
    compute: Callable[[DataFrame, Callable[[], Window]], DataFrame],
    cell_rows: int = 100_000,
) -> DataFrame:
    """Apply ``compute(df, window)`` whose frames look at most ``radius`` rows away.

    Large groups are cut into cells of consecutive rows; each cell also receives
    ``radius`` rows of both neighbours, which are dropped after the computation.
    """
    by = list(by)
    cell_rows = max(min(cell_rows, _limit(df)), radius)

    def plain(part: DataFrame) -> DataFrame:
        return compute(part, lambda: Window.partitionBy(*by).orderBy(*order))

    def spread(part: DataFrame) -> DataFrame:
        placed = _spread_position(part, by, order, bins, "__pos").withColumn(
            "__home", F.floor((F.col("__pos") - 1) / cell_rows)
        )
        offset = (F.col("__pos") - 1) % cell_rows
        cells = F.array_compact(
            F.array(
                F.col("__home"),
                F.when((offset < radius) & (F.col("__home") > 0), F.col("__home") - 1),
                F.when(offset >= cell_rows - radius, F.col("__home") + 1),
            )
        )
        copied = placed.withColumn("__cell", F.explode(cells))
        done = compute(copied, lambda: Window.partitionBy(*by, "__cell").orderBy(*order))
        return done.filter(F.col("__cell") == F.col("__home")).drop("__pos", "__home", "__cell")

    return by_size(df, by, plain, spread)


def running(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    bins: Sequence[Column],
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    maxima: dict[str, Column] | None = None,
    reverse: bool = False,
) -> DataFrame:
    """Running sums, running maxima and last non-null values up to and including each row.

    With ``reverse`` the scan goes from the end of the group.
    """
    by, sums, lasts, maxima = list(by), sums or {}, lasts or {}, maxima or {}
    steps = [F.col(o).desc() if reverse else F.col(o).asc() for o in order]

    def inside(keys: list[str]) -> Window:
        return Window.partitionBy(*keys).orderBy(*steps).rowsBetween(Window.unboundedPreceding, 0)

    def columns(w: Window) -> dict[str, Column]:
        return {
            **{n: F.sum(c).over(w) for n, c in sums.items()},
            **{n: F.max(c).over(w) for n, c in maxima.items()},
            **{n: F.last(c, ignorenulls=True).over(w) for n, c in lasts.items()},
        }

    def plain(part: DataFrame) -> DataFrame:
        return part.select("*", *[c.alias(n) for n, c in columns(inside(by)).items()])

    def spread(part: DataFrame) -> DataFrame:
        part = part.withColumn("__bin", F.struct(*bins))
        key = F.struct(*order)
        pick = F.min_by if reverse else F.max_by
        totals = part.groupBy(*by, "__bin").agg(
            *[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()],
            *[F.max(c).alias(f"__t_{n}") for n, c in maxima.items()],
            *[pick(c, F.when(c.isNotNull(), key)).alias(f"__t_{n}") for n, c in lasts.items()],
        )
        step = F.col("__bin").desc() if reverse else F.col("__bin").asc()
        before = Window.partitionBy(*by).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
        carry = totals.select(
            *by,
            "__bin",
            *[F.sum(f"__t_{n}").over(before).alias(f"__c_{n}") for n in sums],
            *[F.max(f"__t_{n}").over(before).alias(f"__c_{n}") for n in maxima],
            *[F.last(f"__t_{n}", ignorenulls=True).over(before).alias(f"__c_{n}") for n in lasts],
        )
        local = part.select("*", *[c.alias(n) for n, c in columns(inside([*by, "__bin"])).items()])
        out = _join_back(local, carry, [*by, "__bin"])
        for n in sums:
            out = out.withColumn(
                n, F.when(F.col(n).isNull(), F.col(f"__c_{n}")).otherwise(F.col(n) + F.coalesce(F.col(f"__c_{n}"), F.lit(0)))
            )
        for n in maxima:
            out = out.withColumn(n, F.greatest(F.col(n), F.col(f"__c_{n}")))
        for n in lasts:
            out = out.withColumn(n, F.coalesce(F.col(n), F.col(f"__c_{n}")))
        return out.drop("__bin", *[f"__c_{n}" for n in [*sums, *lasts, *maxima]])

    return by_size(df, by, plain, spread)


def quantile_bins(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Add ``__qbin``, a per-group coarsening of ``value`` into near-equal parts."""
    points = [i / QUANTILE_BINS for i in range(1, QUANTILE_BINS)]
    sketch = F.percentile_approx(value, F.array(*map(F.lit, points)), F.lit(4000)).alias("__cuts")
    cuts = df.groupBy(*by).agg(sketch) if by else df.agg(sketch)
    if by:
        keyed = cuts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(by)], "__cuts")
        joined = df.join(F.broadcast(keyed), _same_key(df, by), "left").drop(*[f"__k{i}" for i in range(len(by))])
    else:
        joined = df.withColumn("__cuts", cuts.scalar())
    value_col = F.col(value)
    return joined.withColumn("__qbin", F.size(F.filter("__cuts", lambda c: c < value_col))).drop("__cuts")


def quantiles(df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact linear-interpolated quantiles per group; nulls are ignored."""
    by = list(by)
    df = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__v"))

    def plain(part: DataFrame) -> DataFrame:
        aggs = [F.percentile("__v", F.lit(p)).alias(n) for n, p in probs.items()]
        return part.groupBy(*by).agg(*aggs) if by else part.agg(*aggs)

    def spread(part: DataFrame) -> DataFrame:
        binned = quantile_bins(part, by, "__v")
        placed = _spread_position(binned, by, ["__v"], [F.col("__qbin")], "__pos")
        sizes = (part.groupBy(*by) if by else part).agg(F.count(F.lit(1)).alias("__size"))
        joined = _join_back(placed, F.broadcast(sizes), by) if by else placed.withColumn("__size", sizes.scalar())
        aggs, outs = [], []
        for i, (n, p) in enumerate(probs.items()):
            rank = F.lit(p) * (F.col("__size") - 1)
            at = F.col("__pos") - 1
            aggs += [
                F.max(F.when(at == F.floor(rank), F.col("__v"))).alias(f"__lo{i}"),
                F.max(F.when(at == F.ceil(rank), F.col("__v"))).alias(f"__hi{i}"),
                F.max(rank - F.floor(rank)).alias(f"__f{i}"),
            ]
            outs.append((F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}")) * F.col(f"__f{i}")).alias(n))
        grouped = joined.groupBy(*by).agg(*aggs) if by else joined.agg(*aggs)
        return grouped.select(*by, *outs)

    return by_size(df, by, plain, spread)


def first_rows(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], k: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows per group.

    ``row_number <= k`` lets Spark cut every group to k rows before the shuffle.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    kept = df.withColumn(rank or "__rank", F.row_number().over(w)).filter(F.col(rank or "__rank") <= k)
    return kept if rank else kept.drop("__rank")


def cut_in_tasks(df: DataFrame, by: str, order: dict[str, bool], k: int) -> DataFrame:
    """Drop rows that cannot be among the first ``k`` of their group, batch by batch and without a sort or shuffle of all rows.

    ``by`` and the keys of ``order`` (name: ascending) are numbers; rows with a null or NaN
    in them stay.  What is left still holds the first ``k`` rows of every group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(batch.schema.get_field_index(n)) for n in (by, *order)]
            plain = np.ones(batch.num_rows, bool)
            for key in keys:
                plain &= ~pc.is_null(key, nan_is_null=True).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(plain)
            group, *steps = [key.filter(pa.array(plain)).to_numpy(zero_copy_only=False) for key in keys]
            steps = [v if up else -v for v, up in zip(steps, order.values())]
            place = np.lexsort([*steps[::-1], group])
            group = group[place]
            head = np.flatnonzero(np.append(True, group[1:] != group[:-1])[: len(group)])
            rank = np.arange(len(group)) - np.repeat(head, np.diff(np.append(head, len(group))))
            kept = np.sort(np.concatenate([at[place[rank < k]], np.flatnonzero(~plain)]))
            yield batch.take(pa.array(kept))

    return df.mapInArrow(run, df.schema)


def cut_by_bounds(df: DataFrame, by: str, tier: str, low: str, high: str, sure: str, k: str, margin: float) -> DataFrame:
    """Drop rows that cannot be among the first of their group by (tier ascending, value descending), batch by batch.

    A row's value lies between ``low`` and ``high`` and its ``tier`` is 0 or 1.  It goes when ``k`` rows
    of its group are ahead of it whatever the values; only ``sure`` rows count as such or go.
    ``k`` is a column of the group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = lambda n: batch.column(batch.schema.get_field_index(n))
            firm = column(sure).to_numpy(zero_copy_only=False)
            group, level, least, most, ahead = (column(n).to_numpy(zero_copy_only=False) for n in (by, tier, low, high, k))
            at = np.flatnonzero(firm)
            place = at[np.lexsort([-least[at], level[at], group[at]])]
            kept = ~firm
            heads = np.flatnonzero(np.append(True, group[place][1:] != group[place][:-1])[: len(place)])
            for i, j in zip(heads, np.append(heads[1:], len(place))):
                rows = place[i:j]
                need, first = int(ahead[rows[0]]), int((level[rows] == 0).sum())
                for part, before in ((rows[:first], 0), (rows[first:], first)):
                    if before < need and len(part):
                        kept[part] = most[part] >= (least[part[need - 1]] - margin if len(part) >= need else -np.inf)
            yield batch.take(pa.array(np.flatnonzero(kept)))

    return df.mapInArrow(run, df.schema)


def numbered(df: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """1-based row number over the whole table, for any size and any ties: range partitions are numbered inside and shifted by the sizes of the earlier ones."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = cut_lineage(placed)
    run, inside = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(run.alias("__run")).agg(F.count(F.lit(1)).alias("__size"))  # a row per partition
    earlier = Window.orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__run", F.coalesce(F.sum("__size").over(earlier), F.lit(0)).alias("__start"))
    joined = placed.join(F.broadcast(starts), run == F.col("__run"))
    return joined.withColumn(name, F.col("__start") + inside + 1).drop("__at", "__run", "__size", "__start")


def numbered_within(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "position") -> DataFrame:
    """1-based row number per group for any group size: the table's row numbers less the group's first one."""
    placed = numbered(df, [*[F.col(b).asc_nulls_first() for b in by], *order], "__global")
    firsts = placed.groupBy(*by).agg(F.min("__global").alias("__first"))
    return _join_back(placed, firsts, list(by)).withColumn(name, F.col("__global") - F.col("__first") + 1).drop("__global", "__first")


def attach(df: DataFrame, by: Sequence[str], **aggs: Column) -> DataFrame:
    """Add group aggregates to every row by aggregate-then-join, which never gathers a group."""
    totals = df.groupBy(*by).agg(*[a.alias(n) for n, a in aggs.items()])
    return _join_back(df, totals, list(by))


def explode_bins(df: DataFrame, start: Column, end: Column, width: float, name: str = "__cell") -> DataFrame:
    """One copy of each interval per time bin it touches."""
    return df.withColumn(name, F.explode(F.sequence(F.floor(start / width), F.floor(end / width))))
