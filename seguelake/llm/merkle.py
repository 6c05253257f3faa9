"""A Merkle manifest of a dataset, with proofs made per partition (Octopus multiproof).

Rows are leaves.  Every group has a binary tree over its leaves in a given order;
a last node without a partner is hashed alone.  The groups' roots, in the order
of the groups, are the leaves of one more tree.  A node is the SHA-256 of its
children's digests, written as hex text one after the other.

* ``build`` numbers the leaves by range partitioning, so no group meets in one
  task, and hashes trees from the bottom in aligned blocks of 2^SPAN nodes: a
  round per SPAN levels, whatever the number of rows.
* ``prove`` deals leaves in runs of ``PART`` (a run may cross groups).  A run
  names the union of the nodes it cannot compute itself: at each level the
  siblings of its nodes that are not its own.  These are fetched in one join,
  shared inner nodes are computed once per run, and each leaf's own proof is read
  off them.
* ``fold`` recomputes a root from any digest and a proof, with SQL functions.

A proof is an array with one (left, right) pair per level; a side without a
sibling is null, so a lone node's step has two nulls.

Nulls and odd cases: a null field is written as ``-``; a null group is a group of
its own and comes first, a null order value comes first in its group; rows with
equal order values are ordered by digest, and rows alike in both are
interchangeable; long texts are hashed by the JVM in their own row; other columns
are ignored unless carried; an empty table gives empty results.
"""

from __future__ import annotations

import hashlib
from binascii import hexlify
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seguelake.session import scratch_path

SPAN = 10
PART = 1024
TOP = -1
BROADCAST_GROUPS = 20_000
PROOF = "array<struct<left string, right string>>"


class Manifest(NamedTuple):
    """``leaves`` (tree, n, idx, part, digest, carried columns), ``nodes`` (tree, level, idx, digest), number of trees."""

    leaves: DataFrame
    nodes: DataFrame
    trees: int


def leaf(fields: Sequence[Column]) -> Column:
    """Hex digest of a row: each field as ``-`` if null, else its UTF-8 length, a colon and its text."""
    texts = [c.cast("string") for c in fields]
    written = [F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return F.sha2(F.concat(*written), 256)


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, f"merkle-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Add the 0-based ``position`` in the given order: range partitions are numbered inside and shifted by the sizes of the earlier ones."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = _stored(placed, name)
    run, inside = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(run.alias("__run")).agg(F.count(F.lit(1)).alias("__size"))  # a row per partition
    earlier = Window.orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__run", F.coalesce(F.sum("__size").over(earlier), F.lit(0)).alias("__start"))
    return placed.join(F.broadcast(starts), run == F.col("__run")).withColumn("position", F.col("__start") + inside).drop("__at", "__run", "__size", "__start")


def depth(n: int) -> int:
    return (int(n) - 1).bit_length()


def _rise(base: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def rise(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("idx")
        tree, n, at = int(block["tree"].iloc[0]), int(block["n"].iloc[0]), int(block["idx"].iloc[0])
        digests, rows = list(block["digest"]), []
        for level in range(base + 1, min(base + SPAN, depth(n)) + 1):
            digests = [hashlib.sha256(hexlify(b"".join(digests[i : i + 2]))).digest() for i in range(0, len(digests), 2)]
            at >>= 1
            rows += [(tree, n, level, at + i, d) for i, d in enumerate(digests)]
        return pd.DataFrame(rows, columns=["tree", "n", "level", "idx", "digest"])

    return rise


def _climb(level0: DataFrame, largest: int, name: str) -> list[DataFrame]:
    """Stored tables of all nodes above ``level0`` (tree, n, idx, digest); ``largest`` is the size of the largest tree."""
    out: list[DataFrame] = []
    below = level0
    for base in range(0, depth(largest) if largest else 0, SPAN):
        taller = below.filter(F.col("n") > (1 << base)).select("tree", "n", "idx", "digest")
        risen = taller.groupBy("tree", F.shiftright("idx", SPAN).alias("__block")).applyInPandas(_rise(base), "tree long, n long, level int, idx long, digest binary")
        out.append(_stored(risen, f"{name}-{base}"))
        below = out[-1].filter(F.col("level") == base + SPAN)
    return out


def build(rows: DataFrame, group: str, order: str, digest: str, carry: Sequence[str] = ()) -> Manifest:
    """Number the leaves of every group by ``order`` and hash all trees.  ``digest`` is a column of hex digests."""
    taken = rows.select(
        F.col(group).alias("__group"), F.col(order).alias("__order"), F.unhex(F.col(digest)).alias("digest"), *[F.col(c).alias(f"c_{c}") for c in carry],
        F.monotonically_increasing_id().alias("__row"),  # lets a run of equal rows be split; equal rows are interchangeable
    )
    ordered = numbered(taken, [F.col("__group").asc_nulls_first(), F.col("__order").asc_nulls_first(), F.col("digest").asc(), F.col("__row").asc()], "ranked").drop("__order", "__row")
    sizes = ordered.groupBy("__group").agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("__first"))
    groups = numbered(sizes, [F.col("__group").asc_nulls_first()], "groups").select(F.col("__group").alias("__g"), F.col("position").alias("tree"), "n", "__first")
    trees, largest = groups.agg(F.count(F.lit(1)), F.max("n")).first()
    groups = F.broadcast(groups) if trees <= BROADCAST_GROUPS else groups
    leaves = ordered.join(groups, F.col("__group").eqNullSafe(F.col("__g")))
    leaves = leaves.select("tree", "n", (F.col("position") - F.col("__first")).alias("idx"), F.floor(F.col("position") / PART).alias("part"), "digest", *[f"c_{c}" for c in carry])
    leaves = _stored(leaves, "leaves")
    inner = _climb(leaves, largest or 0, "inner")
    inner = [t.withColumn("__root", F.expr("shiftleft(1L, level) >= n")) for t in inner]  # no levels above a root are made
    subroots = leaves.filter("n = 1").select("tree", "digest")
    for table in inner:
        subroots = subroots.unionByName(table.filter("__root").select("tree", "digest"))
    subroots = _stored(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.lit(trees).cast("long").alias("n"), F.col("tree").alias("idx"), "digest"), "subroots")
    nodes = [t.withColumn("level", F.lit(0)) for t in (leaves, subroots)] + inner + _climb(subroots, trees, "top")
    shown = [t.select("tree", "level", "idx", "digest") for t in nodes]
    return Manifest(leaves, reduce(DataFrame.unionByName, shown), trees)


def missing(places: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(level, places) of the nodes that proofs of all leaves at ``places`` need and that these leaves do not give."""
    level = 0
    while n > 1:
        siblings = np.setdiff1d(places ^ 1, places)
        yield level, siblings[siblings < n]
        places, n, level = np.unique(places >> 1), (n + 1) >> 1, level + 1


def ascend(places: np.ndarray, n: int, own: np.ndarray, fetched: dict[int, tuple[np.ndarray, np.ndarray]]) -> tuple[list[tuple[np.ndarray, np.ndarray]], bytes]:
    """Per level the known (places, hex digests), own and fetched; and the root.  ``places`` are distinct and ascending."""
    levels, level = [], 0
    while n > 1:
        more = fetched.get(level)
        known, digests = (np.concatenate([places, more[0]]), np.concatenate([own, more[1]])) if more else (places, own)
        order = np.argsort(known, kind="stable")
        known, digests = known[order], digests[order]
        levels.append((known, digests))
        places = np.unique(places >> 1)
        first = np.searchsorted(known, 2 * places)
        pairs = zip(digests[first].tolist(), digests[np.minimum(first + 1, len(known) - 1)].tolist(), (2 * places + 1 < n).tolist())
        own = np.array([hashlib.sha256(a + b if two else a).hexdigest().encode() for a, b, two in pairs], "S64")
        n, level = (n + 1) >> 1, level + 1
    return levels, own[0]


def siblings(places: np.ndarray, n: int, levels: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(digests, kind) of each leaf's sibling at every level; kind 0: it lies left, 1: right, 2: there is none."""
    digests, kind = np.zeros((len(places), len(levels)), "S64"), np.full((len(places), len(levels)), 2, np.uint8)
    for k, (known, values) in enumerate(levels):
        other = places ^ 1
        there = other < n
        digests[there, k] = values[np.searchsorted(known, other[there])]
        kind[there, k] = other[there] & 1  # an even place lies left
        places, n = places >> 1, (n + 1) >> 1
    return digests, kind


def prove(manifest: Manifest, chosen: DataFrame | None = None) -> DataFrame:
    """Carried columns, ``leaf``, ``subroot``, ``root`` and ``proof`` of the chosen rows of ``leaves`` (all by default)."""
    leaves, trees = manifest.leaves if chosen is None else chosen, manifest.trees

    def wanted(run: pd.DataFrame) -> pd.DataFrame:
        found = [(TOP, level, at) for level, at in missing(np.unique(run["tree"].to_numpy()), trees)]
        for (tree, n), some in run.groupby(["tree", "n"]):
            found += [(tree, level, at) for level, at in missing(np.unique(some["idx"].to_numpy()), n)]
        sizes = [len(at) for _, _, at in found]
        columns = [np.repeat([f[0] for f in found], sizes), np.repeat([f[1] for f in found], sizes), np.concatenate([f[2] for f in found] or [np.zeros(0)])]
        return pd.DataFrame({"part": run["part"].iloc[0], "tree": columns[0], "level": columns[1], "idx": columns[2]})

    requests = leaves.select("part", "tree", "n", "idx").groupBy("part").applyInPandas(wanted, "part long, tree long, level int, idx long")
    requests = requests.select("part", F.col("tree").alias("r_tree"), F.col("level").alias("r_level"), F.col("idx").alias("r_idx"))
    nodes = manifest.nodes
    found = requests.join(nodes, F.expr("r_tree = tree AND r_level = level AND r_idx = idx"))
    fetched = found.select("part", F.col("r_tree").alias("tree"), F.col("r_level").alias("level"), F.col("r_idx").alias("idx"), F.col("digest").alias("digest"))
    carried = [c for c in leaves.columns if c.startswith("c_")]
    fields = [f for f in leaves.schema.fields if f.name in carried]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields], "leaf string, subroot string, root string", f"proof {PROOF}"])

    def expand(run: pa.Table, given: pa.Table) -> pa.Table:
        run = run.sort_by([("tree", "ascending"), ("idx", "ascending")])
        known: dict[int, dict[int, tuple[np.ndarray, np.ndarray]]] = {}
        if given.num_rows:
            at = pd.DataFrame({"tree": given["tree"].to_numpy(), "level": given["level"].to_numpy()})
            places, digests = given["idx"].to_numpy(), np.array([hexlify(d) for d in given["digest"].to_pylist()], "S64")
            for (tree, level), rows in at.groupby(["tree", "level"]).indices.items():
                known.setdefault(tree, {})[level] = places[rows], digests[rows]
        tree, n, idx = (run[c].to_numpy() for c in ("tree", "n", "idx"))
        own = np.array([hexlify(d) for d in run["digest"].to_pylist()], "S64")
        first = np.flatnonzero(np.diff(tree, prepend=tree[0] - 1))
        ends = np.append(first[1:], len(tree))
        subroots, steps = [], []
        for a, b in zip(first.tolist(), ends.tolist()):
            levels, subroot = ascend(idx[a:b], int(n[a]), own[a:b], known.get(int(tree[a]), {}))
            subroots.append(subroot)
            steps.append(siblings(idx[a:b], int(n[a]), levels))
        levels, root = ascend(tree[first], trees, np.array(subroots, "S64"), known.get(TOP, {}))
        above, side = siblings(tree[first], trees, levels)
        digests = [np.concatenate([d, np.broadcast_to(above[i], (len(d), above.shape[1]))], 1) for i, (d, _) in enumerate(steps)]
        kinds = [np.concatenate([k, np.broadcast_to(side[i], (len(k), side.shape[1]))], 1) for i, (_, k) in enumerate(steps)]
        sizes = np.concatenate([np.full(len(d), d.shape[1]) for d in digests])
        flat, kind = np.concatenate([d.reshape(-1) for d in digests]), np.concatenate([k.reshape(-1) for k in kinds])
        sides = [pa.array(flat, pa.binary(), mask=kind != k).cast(pa.string()) for k in (0, 1)]
        proof = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.StructArray.from_arrays(sides, ["left", "right"]))
        many = np.repeat(np.array(subroots, "S64"), ends - first)
        texts = [pa.array(x, pa.binary()).cast(pa.string()) for x in (own, many, np.full(len(own), root, "S64"))]
        return pa.Table.from_arrays([*[run[c].combine_chunks() for c in carried], *texts, proof], names=[*carried, "leaf", "subroot", "root", "proof"])

    proofs = leaves.groupBy("part").cogroup(fetched.groupBy("part")).applyInArrow(expand, schema)
    return proofs.select(*[F.col(c).alias(c[2:]) for c in carried], "leaf", "subroot", "root", "proof")


def fold(digest: Column, proof: Column) -> Column:
    """The root that ``digest`` and a proof lead to."""
    return F.aggregate(proof, digest, lambda below, step: F.sha2(F.concat(F.coalesce(step["left"], F.lit("")), below, F.coalesce(step["right"], F.lit(""))), 256))


def proof_digest(proof: Column) -> Column:
    """SHA-256 of a proof's siblings, one after the other."""
    return F.sha2(F.array_join(F.transform(proof, lambda step: F.coalesce(step["left"], step["right"], F.lit(""))), ""), 256)
