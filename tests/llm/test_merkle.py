"""The Merkle manifest against a plain tree on small tables."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from seguelake.llm import merkle
from seguelake.llm import queries as registered

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, tree string, part long"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return H(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)])


def climb(nodes):
    """All levels of one tree."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([H(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return levels


def proof_of(levels, at):
    steps = []
    for level in levels[:-1]:
        other = at ^ 1
        steps.append((None, None) if other >= len(level) else (level[other], None) if other < at else (None, level[other]))
        at >>= 1
    return steps


def folded(digest, steps):
    for left, right in steps:
        digest = H(left or "", digest, right or "")
    return digest


def expected(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of rows (doc_id, text, lang, source, n_chars, ...)."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    members = {g: sorted(((r[0] is not None, r[0] or 0, leaf(r[0], r[3], r[2], r[4], r[1]), r) for r in rows if r[2] == g), key=lambda x: x[:3]) for g in langs}
    trees = {g: climb([m[2] for m in members[g]]) for g in langs}
    top = climb([trees[g][-1][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        for i, (_, _, digest, r) in enumerate(members[g]):
            steps = proof_of(trees[g], i) + proof_of(top, k)
            tamper = zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 == 0
            claimed = leaf(r[0], r[3], r[2], r[4] + 1 if r[4] is not None else None, r[1]) if tamper else digest
            root = folded(claimed, steps)
            out.append((r[0], digest, trees[g][-1][0], top[-1][0], H(*[a or b or "" for a, b in steps]), root, root == top[-1][0]))
    return sorted(out, key=str)


def fixture():
    langs = ["en"] * 29 + ["fr"] * 5 + [None] * 3 + ["é", "", "a"] + ["zz"] * 2
    rows = [(i * 3 % 101, [None, "", "text é " * (i % 5)][i % 3], g, "s" if i % 4 else None, i if i % 6 else None, "clash", "clash", 7) for i, g in enumerate(langs)]
    rows += [(None, "no id", "en", "s", 1, None, None, None), (500, "long " * 60_000, "en", "s", 300_000, "x", "y", 1)]
    return rows + [rows[2], rows[2], (rows[2][0], "same id, other text", rows[2][2], None, 4, "q", "q", 0)]


def run(spark, rows, folder, schema=SCHEMA):
    spark.createDataFrame(rows, schema).repartition(5).write.parquet(f"{folder}/documents.parquet")
    return registered.QUERIES["op11_merkle_manifest"](spark, str(folder))


@pytest.mark.parametrize("part", [4, 1024])
def test_query_against_a_plain_tree(spark, tmp_path, monkeypatch, part):
    monkeypatch.setattr(merkle, "PART", part)
    monkeypatch.setattr(merkle, "SPAN", 2 if part == 4 else 10)
    got = run(spark, fixture(), tmp_path)
    assert sorted(map(tuple, got.collect()), key=str) == expected(fixture())
    assert any(not r[-1] for r in expected(fixture())) and any(r[-1] for r in expected(fixture()))


def test_one_row_and_no_rows(spark, tmp_path):
    one = [(3, "x", None, None, None, None, None, None)]
    assert sorted(map(tuple, run(spark, one, tmp_path / "one").collect()), key=str) == expected(one)
    assert run(spark, [], tmp_path / "none").collect() == []


def test_chosen_leaves_need_only_the_minimal_union(spark):
    rows = spark.range(100).select(F.lit("g").alias("g"), F.col("id"), F.sha2(F.col("id").cast("string"), 256).alias("d"))
    tree = merkle.build(rows, "g", "id", "d", carry=("id",))
    some = tree.leaves.filter("c_id IN (3, 4, 5, 98)")
    levels = climb([H(str(i)) for i in range(100)])
    for r in merkle.prove(tree, some).collect():
        assert [tuple(s) for s in r.proof] == proof_of(levels, r.id) and r.root == levels[-1][0]
    # 2; 2,3 -> 1 at level 1 is own; a node is named once and never if own leaves give it
    named = {(level, int(x)) for level, at in merkle.missing(np.array([3, 4, 5, 98]), 100) for x in at}
    needed = {(level, (i >> level) ^ 1) for i in (3, 4, 5, 98) for level in range(7)}
    own = {(level, i >> level) for i in (3, 4, 5, 98) for level in range(8)}
    width = [len(x) for x in levels]
    assert named == {(level, x) for level, x in needed - own if x < width[level]}


def test_a_changed_sibling_is_noticed(spark):
    rows = spark.range(9).select(F.lit(None).cast("string").alias("g"), F.col("id"), F.sha2(F.col("id").cast("string"), 256).alias("d"))
    proofs = merkle.prove(merkle.build(rows, "g", "id", "d", carry=("id",)))
    broken = F.transform("proof", lambda s: F.struct(s["left"].alias("left"), F.reverse(s["right"]).alias("right")))
    got = {r.id: r.same for r in proofs.select("id", (merkle.fold(F.col("leaf"), broken) == F.col("root")).alias("same")).collect()}
    assert got[8] and not any(got[i] for i in range(8) if i != 7)  # leaf 8 has left siblings only
