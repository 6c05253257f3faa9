"""A shopping list by one walk over ranked items, done for all items at once.

The walk takes items from the best down and keeps an item unless a kept one has the
same title key or is a near copy of it; a kept item needs an explaining item, its
first, second or third choice that explains fewer than ``hub_cap`` so far.  What
happens to an item depends on better ones only, so every round decides all items for
which the better ones that matter are decided:

* an item goes if a kept better item shares its title key or is nearer than
  ``near_copy``, or if all its explaining items are full with better ones;
* it stays if no better undecided item could still stand in its way: none has its
  title key or lies near, and fewer than ``hub_cap`` kept or undecided better items
  name the first explaining item that is not full.

The best undecided item is always decided, so rounds end; the result is that of the
walk, whatever the order of the input.  Nothing is compared pair by pair in the
output: titles and explaining items are decided from the best rank per key, and near
copies from one row per item and block of a distance-pruned scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seguelake import grouping
from seguelake.functions import text, vectors
from seguelake.operators.vectors import slices
from seguelake.session import cut_lineage

c = F.col
BLOCK_ROWS = 4096
MAX_PIVOTS = 1024
NO_RANK = 1 << 62


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, 1))


def placed(items: DataFrame, reach: float) -> DataFrame:
    """items(id, v) with unit vectors: add ``cell``, the nearest pivot, ``cells``, those that hold rows within ``reach``, and ``parts``, the blocks of each."""
    n = items.count()
    wanted = int(min(MAX_PIVOTS, max(1, n // BLOCK_ROWS)))
    found = items.orderBy(F.xxhash64("id"), "id").limit(wanted).select("v").collect()  # at most MAX_PIVOTS vectors
    pivots = np.array([r["v"] for r in found]) if found else np.zeros((1, 1))

    def distances(part: pd.DataFrame) -> np.ndarray:
        return np.sqrt(np.maximum(2.0 - 2.0 * (_matrix(part["v"]) @ pivots.T), 0.0))

    def assign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if len(p):
                d = distances(p)
                yield p.assign(cell=d.argmin(1).astype("int32"), d=d.min(1))

    near = cut_lineage(items.select("id", "v").mapInPandas(assign, "id long, v array<double>, cell int, d double"))
    sizes = near.groupBy("cell").agg(F.max("d").alias("radius"), F.count(F.lit(1)).alias("size")).collect()  # a row per pivot
    radius, blocks = np.full(len(pivots), -np.inf), {r["cell"]: -(-r["size"] // BLOCK_ROWS) for r in sizes}
    for r in sizes:
        radius[r["cell"]] = r["radius"]

    def open_cells(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in parts:
            for p in slices(whole):  # a row may name every cell
                hit = distances(p) <= radius + reach + 1e-9
                yield p[["id", "v", "cell"]].assign(cells=[[{"cell": int(x), "parts": blocks[int(x)]} for x in np.flatnonzero(row)] for row in hit], parts=[blocks[x] for x in p["cell"]])

    return near.mapInPandas(open_cells, "id long, v array<double>, cell int, cells array<struct<cell: int, parts: int>>, parts int")


def near_ranks(queries: DataFrame, targets: DataFrame, near_copy: float) -> DataFrame:
    """Best rank of the kept and of the undecided targets nearer than ``near_copy`` to each query: (id, near_kept, near_open)."""
    own = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    left = queries.select("id", "v", F.explode("cells").alias("z")).select("id", "v", c("z.cell").alias("cell"), own(c("z.parts")).alias("qb"), F.explode(F.sequence(F.lit(0), c("z.parts") - 1)).alias("tb"))
    # both sides may come from one table: the columns of the right one get identities of their own
    renamed = [c(n).alias(n) for n in ("id", "v", "rank", "kept", "cell")]
    right = targets.select(*renamed, own(c("parts")).alias("tb"), F.explode(F.sequence(F.lit(0), c("parts") - 1)).alias("qb"))

    def scan(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "near_kept": [], "near_open": []})
        targets, ranks, ids, kept = _matrix(b["v"]).T, b["rank"].to_numpy(), b["id"].to_numpy(), b["kept"].to_numpy(bool)
        out = []
        for part in slices(a):
            near = (_matrix(part["v"]) @ targets > near_copy) & (part["id"].to_numpy()[:, None] != ids[None, :])
            best = lambda cols: np.where(near[:, cols], ranks[cols], NO_RANK).min(1, initial=NO_RANK)  # noqa: B023, E731
            out.append(pd.DataFrame({"id": part["id"], "near_kept": best(kept), "near_open": best(~kept)}))
        found = pd.concat(out)
        return found[(found["near_kept"] < NO_RANK) | (found["near_open"] < NO_RANK)]

    keys = ["cell", "qb", "tb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(scan, "id long, near_kept long, near_open long")
    return found.groupBy("id").agg(F.min("near_kept").alias("near_kept"), F.min("near_open").alias("near_open"))


def _capacity(rows: DataFrame, hub_cap: int, name: str) -> DataFrame:
    """Rank of the ``hub_cap``-th best row per explaining item, where there are so many."""
    best = grouping.first_rows(rows, ["hub"], ["rank"], hub_cap)
    return best.groupBy("hub").agg(F.max("rank").alias(name), F.count(F.lit(1)).alias("__n")).filter(c("__n") >= hub_cap).select(c("hub").alias(f"{name}_hub"), name)


def walk(items: DataFrame, near_copy: float = 0.995, hub_cap: int = 2) -> DataFrame:
    """items(id, rank, tkey, hubs, v): the kept ones with their explaining item: (id, rank, hub).  Ranks are distinct and the smallest is best."""
    reach = float(np.sqrt(max(0.0, 2.0 - 2.0 * near_copy)))
    cells = placed(items, reach).drop("v")
    undecided = items.join(cells, "id").withColumns({"kept": F.lit(False), "hub": F.lit(None).cast("long"), "lone": F.lit(False)})
    undecided = cut_lineage(undecided)
    # most items have no near copy at all and stay out of later scans
    linked = near_ranks(undecided, undecided, near_copy).select(c("id").alias("l_id"))
    undecided = cut_lineage(undecided.join(linked, c("id") == c("l_id"), "left").withColumn("lone", c("l_id").isNull()).drop("l_id"))
    kept = undecided.limit(0)
    while not undecided.isEmpty():
        both = undecided.unionByName(kept)
        titles = both.groupBy(c("tkey").alias("t_key")).agg(F.min("rank").alias("t_best"), F.min(F.when(c("kept"), c("rank"))).alias("t_kept"))
        named = both.select("rank", "kept", F.explode(F.when(c("kept"), F.array("hub")).otherwise(c("hubs"))).alias("hub"))
        any_cut, kept_cut = _capacity(named, hub_cap, "any_cut"), _capacity(named.filter("kept"), hub_cap, "kept_cut")
        wished = undecided.select("id", "rank", F.posexplode("hubs").alias("pos", "wish")).join(any_cut, c("wish") == c("any_cut_hub"), "left").join(kept_cut, c("wish") == c("kept_cut_hub"), "left")
        free = F.coalesce(c("kept_cut") > c("rank"), F.lit(True))
        sure = F.coalesce(c("rank") <= c("any_cut"), F.lit(True))
        offers = wished.filter(free).groupBy(c("id").alias("o_id")).agg(F.min(F.struct("pos", sure.alias("sure"), "wish")).alias("offer"))
        near = near_ranks(undecided.filter(~c("lone")), both.filter(~c("lone")), near_copy).withColumnRenamed("id", "n_id")
        d = undecided.join(titles, c("tkey") == c("t_key")).join(offers, c("id") == c("o_id"), "left").join(near, c("id") == c("n_id"), "left")
        gone = c("offer").isNull() | F.coalesce(c("t_kept") < c("rank"), F.lit(False)) | F.coalesce(c("near_kept") < c("rank"), F.lit(False))
        stays = (c("t_best") == c("rank")) & F.coalesce(c("near_open") > c("rank"), F.lit(True)) & c("offer.sure")
        d = d.filter(~gone).withColumns({"kept": stays, "hub": F.when(stays, c("offer.wish"))})
        d = cut_lineage(d.select(*undecided.columns))
        kept = cut_lineage(kept.unionByName(d.filter("kept")))
        undecided = d.filter("NOT kept")
    return kept.select("id", "rank", "hub")


def discovery_list(candidates: DataFrame, library: DataFrame, titles: DataFrame, owned: float = 0.985, near_copy: float = 0.995, hub_cap: int = 2, explainers: int = 3) -> DataFrame:
    """candidates(id, vec), library(id, vec), titles(id, title): (rank, id, hub, sim), best first, without a cut.

    ``sim`` is the similarity to the nearest library item; items above ``owned`` and items
    whose title has no letters or digits are left out.
    """
    from seguelake.functions.numeric import rounded
    from seguelake.operators.vectors import knn_join

    near = knn_join(candidates, library, explainers)
    top = near.groupBy(c("q").alias("id")).agg(F.max("sim").alias("sim"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "t"))), lambda x: x["t"]).alias("hubs"))
    named = titles.select(c("id").alias("t_id"), text.compact_key(c("title")).alias("tkey")).filter("tkey <> ''")
    units = candidates.select(c("id").alias("v_id"), vectors.unit(c("vec")).alias("v"))
    d = top.filter(c("sim") <= owned).join(named, c("id") == c("t_id")).join(units, c("id") == c("v_id")).select("id", "sim", "hubs", "tkey", "v")
    ranked = cut_lineage(grouping.numbered(d, [rounded(c("sim"), 12).desc(), c("id").asc()], "rank"))
    kept = walk(ranked.select("id", "rank", "tkey", "hubs", "v"), near_copy, hub_cap)
    out = kept.join(ranked.select("id", "sim"), "id").select("id", "hub", "sim", c("rank").alias("__rank"))
    return grouping.numbered(out, [c("__rank").asc()], "rank").drop("__rank")
