"""Exact set-similarity join of documents on word n-grams.

Documents with equal n-gram sets form a class and are compared once.  Every class
orders its n-grams rare-first and posts a prefix just long enough that two classes
of the wanted similarity must share a posted n-gram.  Classes that meet under an
n-gram become candidates if the length and positional filters let them; candidates
are verified once per pair, behind a suffix filter, on the whole sets.

A group of near copies would give a number of pairs that grows with its square.
Only its connection is wanted, so classes are first compared with two centres under
each n-gram, the smallest class and the one with most shared n-grams; after that only classes that are still in
different components meet.  No link between components can be missed: under every
shared n-gram the classes outside its most common component meet all others.

Rareness comes from counts of n-grams hashed into a fixed table, which only ever
decides the order: any order gives the same links.

Nulls and odd cases: a text without words has an empty set and links with nothing;
a text with fewer than n words has its whole word sequence as its one n-gram; null
ids are reported with a null component and link nothing; repeated ids and rows
share components; a very long text is one set; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seguelake.llm import words as W
from seguelake.llm.components import components
from seguelake.session import cut_lineage

RANK_BITS = 18
SIEVE_BITS = 24
ADDERS = 32
SKETCH = ("s0", "s1", "s2", "s3")


def ceil_div(a, b):
    return -(-a // b)


def shingle_sets(block: W.Block, prints: W.Fingerprints, n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram fingerprints of each text of a block."""
    data = W.LOWER[block.data]
    start, end, text = block.words()
    ids = prints.spans(prints.prefix(data), start, end)
    counts = block.per_text(text)
    first = np.cumsum(counts) - counts
    gram, at = W.grams(ids, text, n)
    cut = np.searchsorted(text[at], np.arange(block.n + 1))
    sets = [np.unique(gram[cut[i] : cut[i + 1]]) for i in range(block.n)]
    for i in np.flatnonzero((counts > 0) & (counts < n)):
        whole = np.array([counts[i]], np.uint64)
        for k in range(first[i], first[i] + counts[i]):
            whole = W.mix(whole * np.uint64(W.STEP) + ids[k : k + 1])
        sets[i] = whole
    return sets


def class_of(shingles: np.ndarray) -> int:
    """A 64-bit name of a set, as a signed number."""
    if not len(shingles):
        return 0
    total = np.array([np.add.reduce(W.mix(shingles + np.uint64(W.ODD))) ^ np.uint64(len(shingles))])
    return int(W.mix(total).view(np.int64)[0])


def parity_sketch(shingles: np.ndarray) -> np.ndarray:
    """256 parity bits as four signed numbers.  An n-gram flips one bit, so two sketches differ in no more bits than the sets differ in n-grams."""
    odd = np.bincount((W.mix(shingles + np.uint64(1)) & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def ranked(shingles: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The set renamed one-to-one so that ascending order is rare-first."""
    low = np.uint64((1 << RANK_BITS) - 1)
    return np.sort((ranks[(shingles & low).astype(np.int64)].astype(np.uint64) << np.uint64(64 - RANK_BITS)) | (shingles >> np.uint64(RANK_BITS)))


def suffix_apart(a: np.ndarray, b: np.ndarray, allowed: int, depth: int = 3) -> int:
    """A lower bound on the size of the symmetric difference of two sorted arrays, by splitting both at a middle value."""
    if depth == 0 or not len(a) or not len(b):
        return abs(len(a) - len(b))
    pivot = b[len(b) // 2]
    i, j = np.searchsorted(a, pivot), len(b) // 2
    hit = i < len(a) and a[i] == pivot
    left = abs(i - j)
    right = abs((len(a) - i - hit) - (len(b) - j - 1))
    if left + right + (not hit) > allowed:
        return left + right + (not hit)
    left = suffix_apart(a[:i], b[:j], allowed, depth - 1)
    return left + (not hit) + suffix_apart(a[i + hit :], b[j + 1 :], allowed, depth - 1)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, behind the suffix filter."""
    need = ceil_div(percent * (len(a) + len(b)), 100 + percent)
    allowed = len(a) + len(b) - 2 * need
    if suffix_apart(a, b, allowed) > allowed:
        return False
    return len(np.intersect1d(a, b, assume_unique=True)) >= need


def _describe(docs: DataFrame, n: int) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n_shingles, cls, s0 to s3) of every row, and the rank of each hashed n-gram count."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints, seen = W.Fingerprints(), np.zeros(1 << RANK_BITS, np.int64)
        names = ["doc_id", "n_shingles", "cls", *SKETCH, "tally"]
        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            sizes, classes, sketches = [], [], [np.zeros((0, 4), np.int64)]
            for block in W.blocks(batch.column(1)):
                sets = shingle_sets(block, prints, n)
                sizes += [len(s) for s in sets]
                classes += [class_of(s) for s in sets]
                sketches.append(np.stack([parity_sketch(s) for s in sets]))
                seen += np.bincount((np.concatenate(sets) & np.uint64(len(seen) - 1)).astype(np.int64), minlength=len(seen))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), *[pa.array(c) for c in np.concatenate(sketches).T], pa.nulls(len(sizes), pa.binary())], names=names)
        if id_type is not None:
            tally = zstandard.compress(seen.tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.nulls(1, id_type), *[pa.nulls(1, pa.int64())] * 6, pa.array([tally], pa.binary())], names=names)

    both = cut_lineage(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, cls long, s0 long, s1 long, s2 long, s3 long, tally binary"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << RANK_BITS, np.int64)
        for batch in batches:
            for blob in batch.column(0):
                total += np.frombuffer(zstandard.decompress(blob.as_py()), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([zstandard.compress(total.tobytes(), 1)], pa.binary())], names=["tally"])

    sums = both.filter("tally IS NOT NULL").select("tally").repartition(ADDERS).mapInArrow(add, "tally binary").collect()  # ADDERS fixed-size tables
    total = np.sum([np.frombuffer(zstandard.decompress(bytes(r.tally)), np.int64) for r in sums], axis=0) if sums else np.zeros(1 << RANK_BITS)
    ranks = np.empty(1 << RANK_BITS, np.uint32)
    ranks[np.argsort(total, kind="stable")] = np.arange(1 << RANK_BITS, dtype=np.uint32)
    return both.filter("tally IS NULL").drop("tally"), ranks


def _postings(docs: DataFrame, n: int, percent: int, ranks: np.ndarray) -> DataFrame:
    """(key, cls, size, pos) for each n-gram of each prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # 256 KB whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = W.Fingerprints()
        for batch in batches:
            for block in W.blocks(batch.column(0)):
                sets = [s for s in shingle_sets(block, prints, n) if len(s)]
                heads = [ranked(s, shared.value)[: len(s) - ceil_div(percent * len(s), 100) + 1] for s in sets]
                sizes = np.array([len(h) for h in heads], np.int64)
                if len(sizes):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.concatenate(heads).view(np.int64)),
                            pa.array(np.repeat(np.array([class_of(s) for s in sets], np.int64), sizes)),
                            pa.array(np.repeat(np.array([len(s) for s in sets], np.int32), sizes)),
                            pa.array((np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)),
                        ],
                        names=["key", "cls", "size", "pos"],
                    )

    return docs.select("text").mapInArrow(run, "key long, cls long, size int, pos int")


def _sieve(wanted: DataFrame) -> np.ndarray:
    """A bit table of fixed size in which every wanted class has its bit set; it may let others through."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << (SIEVE_BITS - 3), np.uint8)
        for batch in batches:
            at = batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - SIEVE_BITS)
            np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, (at & np.uint64(7)).astype(np.uint8), dtype=np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([zstandard.compress(bits.tobytes(), 1)], pa.binary())], names=["bits"])

    whole = np.zeros(1 << (SIEVE_BITS - 3), np.uint8)
    for row in wanted.repartition(ADDERS).mapInArrow(mark, "bits binary").toLocalIterator():
        whole |= np.frombuffer(zstandard.decompress(bytes(row.bits)), np.uint8)
    return whole


def _texts(docs: DataFrame, n: int, pairs: DataFrame) -> DataFrame:
    """(cls, body): one packed text per class of ``pairs``.  The sieve keeps most other texts out of the shuffle."""
    wanted = cut_lineage(pairs.select(F.col("x").alias("cls")).union(pairs.select("y")).distinct())
    shared = docs.sparkSession.sparkContext.broadcast(_sieve(wanted))  # 2 MB whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints, packer, bits = W.Fingerprints(), zstandard.ZstdCompressor(3), shared.value
        for batch in batches:
            for block in W.blocks(batch.column(0)):
                rows = []
                for s, a, b in zip(shingle_sets(block, prints, n), block.starts, block.ends):
                    if len(s):
                        cls = class_of(s)
                        at = (cls & 0xFFFFFFFFFFFFFFFF) >> (64 - SIEVE_BITS)
                        if bits[at >> 3] >> (at & 7) & 1:
                            rows.append((cls, packer.compress(block.data[a:b].tobytes())))
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.int64()), pa.array([z for _, z in rows], pa.binary())], names=["cls", "body"])

    bodies = docs.select("text").mapInArrow(run, "cls long, body binary")
    return bodies.join(wanted, "cls", "left_semi").groupBy("cls").agg(F.first("body").alias("body"))


def _verified(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (x, y) that are similar, as links (a, b)."""
    pairs = cut_lineage(pairs)
    if pairs.isEmpty():
        return pairs.select(F.col("x").alias("a"), F.col("y").alias("b"))
    texts = cut_lineage(_texts(docs, n, pairs))
    left = texts.select(F.col("cls").alias("x"), F.col("body").alias("body_x"))
    right = texts.select(F.col("cls").alias("y"), F.col("body").alias("body_y"))
    rows = pairs.join(left, "x").join(right, "y").select("x", "y", "body_x", "body_y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints, opener, kept = W.Fingerprints(), zstandard.ZstdDecompressor(), {}
        for batch in batches:
            good = []
            for x, y, *bodies in zip(*(c.to_pylist() for c in batch.columns)):
                sets = []
                for cls, body in zip((x, y), bodies):
                    if cls not in kept:
                        if len(kept) > 256:
                            kept.clear()
                        block = next(W.blocks(pa.array([opener.decompress(body).decode()])))
                        kept[cls] = shingle_sets(block, prints, n)[0]
                    sets.append(kept[cls])
                if similar(*sets, percent):
                    good.append((x, y))
            yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in good], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _possible(p: str, q: str, percent: int):
    """Length and positional filters for one shared n-gram of classes p and q; neither loses a similar pair."""
    need = F.ceil(F.expr(f"{percent} * ({p}.size + {q}.size) / {100 + percent}.0"))
    reach = F.expr(f"least({p}.pos, {q}.pos) + least({p}.size - {p}.pos, {q}.size - {q}.pos)")
    length = F.expr(f"100L * least({p}.size, {q}.size) >= {percent}L * greatest({p}.size, {q}.size)")
    return length & (reach >= need)


def _close(p: str, q: str, percent: int):
    """The sketch filter for classes p and q; it loses no similar pair."""
    apart = F.expr(" + ".join(f"bit_count({p}.{c} ^ {q}.{c})" for c in SKETCH))
    return apart <= F.expr(f"{p}.size + {q}.size") - 2 * F.ceil(F.expr(f"{percent} * ({p}.size + {q}.size) / {100 + percent}.0"))


def _sketched(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs (x, y) whose sketches let them be similar.  A pair meets under many n-grams, so sketches are looked up per pair, not carried by every posting."""
    body = F.struct("size", *SKETCH)
    one, two = sketches.select(F.col("cls").alias("x"), body.alias("p")), sketches.select(F.col("cls").alias("y"), body.alias("q"))
    return pairs.join(one, "x").join(two, "y").filter(_close("p", "q", percent)).select("x", "y")


def link_documents(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document; component_id is the smallest linked doc_id."""
    described, ranks = _describe(docs, n)
    posts = _postings(docs, n, percent, ranks)
    # exact counts first: most n-grams stand in one text only, and those rows need not travel whole
    often = posts.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("key")
    posts = cut_lineage(posts.join(often, "key", "left_semi").groupBy("key", "cls").agg(F.first("size").alias("size"), F.first("pos").alias("pos")))
    sketches = cut_lineage(described.groupBy("cls").agg(F.first("n_shingles").alias("size"), *[F.first(c).alias(c) for c in SKETCH]))
    # a class with most of its n-grams shared is the likely origin of its group's copies, so it makes a good centre
    spread = posts.groupBy("cls").agg(F.count(F.lit(1)).alias("spread"))
    spread_posts = posts.join(spread, "cls")
    side = F.struct("cls", "size", "pos")
    ends = spread_posts.groupBy("key").agg(F.min(side).alias("lo"), F.max(F.struct("spread", "cls", "size", "pos")).alias("hi"), F.max("cls").alias("last"))
    centres = F.array("lo", F.struct("hi.cls", "hi.size", "hi.pos")).alias("centres")
    met = ends.filter("lo.cls <> last").select("key", centres)

    # neither the postings with their centres nor the stars are kept; only distinct pairs are
    stars = posts.join(met, "key").select(side.alias("own"), F.explode("centres").alias("mid")).filter((F.col("own.cls") != F.col("mid.cls")) & _possible("own", "mid", percent))
    pairs = stars.select(F.least("own.cls", "mid.cls").alias("x"), F.greatest("own.cls", "mid.cls").alias("y")).distinct()
    pairs = _sketched(pairs, sketches, percent)
    links = cut_lineage(_verified(pairs, docs, n, percent))
    joined = components(links)

    placed = posts.join(joined, posts["cls"] == joined["node"], "left").select("key", "cls", "size", "pos", F.coalesce("label", "cls").alias("comp"))
    sizes = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("rows"))
    mixed = sizes.groupBy("key").agg(F.max_by("comp", F.struct("rows", "comp")).alias("major"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    whole = F.struct("cls", "size", "pos", *SKETCH).alias("own")
    left_over = cut_lineage(placed.join(mixed.select("key", "major"), "key").join(sketches.drop("size"), "cls").select("key", whole, "comp", "major"))
    p = left_over.filter("comp <> major").select("key", F.col("own").alias("p"), F.col("comp").alias("p_comp"))
    q = left_over.select(F.col("key").alias("q_key"), F.col("own").alias("q"), F.col("comp").alias("q_comp"), "major")
    meet = (F.col("key") == F.col("q_key")) & (F.col("p_comp") != F.col("q_comp")) & ((F.col("q_comp") == F.col("major")) | (F.col("p.cls") < F.col("q.cls")))
    crossed = p.join(q, meet & _possible("p", "q", percent) & _close("p", "q", percent)).select(F.least("p.cls", "q.cls").alias("x"), F.greatest("p.cls", "q.cls").alias("y")).distinct()
    more = cut_lineage(_verified(crossed, docs, n, percent))
    if not more.isEmpty():
        joined = components(links.union(more))

    named = described.join(joined, described["cls"] == joined["node"], "left").select("doc_id", "n_shingles", F.coalesce("label", "cls").alias("comp"))
    named = cut_lineage(named)
    smallest = named.filter("n_shingles > 0").groupBy("comp").agg(F.min("doc_id").alias("least_id"))
    out = named.join(smallest, "comp", "left")
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    return out.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("least_id")).alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The documents with the smallest id of each group, one row per id and text; rows without an id all stay.

    Rows that share an id but not a text are documents of their own: none is dropped for
    another.  Among rows alike in both the one with the smallest hash of all its columns stays.
    """
    linked = link_documents(docs, n, percent)
    firsts = linked.filter("doc_id = component_id").select("doc_id").distinct()
    row = F.struct(*[F.col(c) for c in docs.columns])
    kept = docs.join(firsts, "doc_id", "left_semi").groupBy(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__text")).agg(F.min_by(row, F.xxhash64(*docs.columns)).alias("__row"))
    return kept.select("__row.*").unionByName(docs.filter("doc_id IS NULL")).select(*docs.columns)
