"""Toxicity by nearest labelled examples.

Terms are words (runs of letters, ASCII lower-cased) and the first five bytes of
longer words.  A bounded, hash-ordered sample of labelled documents per class is
the example store, and all terms of its documents form the vocabulary.  Document
frequencies of that vocabulary are counted over all documents.  For every document
the exact ``k`` nearest examples by TF-IDF cosine are found: the commonest terms are
scored as dense columns and all others through posting lists, and what may be among
the best is scored again in double precision.  Terms that no example holds add nothing
to a product and are left out of the document's length, which scales all its cosines
alike.  Votes weighted by similarity and class share give a raw score; isotonic
regression on the learned-from labels (each without its own vote) calibrates it.

Nulls and odd cases: null and empty texts and texts without a term of the examples get
the prior share of toxic labels, calibrated; labels other than 0 and 1 and labels
of unknown ids teach nothing; without labels every score is 0; repeated rows get
equal scores; ties between equal similarities go to the smaller example number;
empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seguelake.grouping import first_rows
from seguelake.llm import words as W
from seguelake.llm.pitman_yor import squeeze, unsqueeze
from seguelake.llm.quality_model import isotonic
from seguelake.session import cut_lineage

STEM_BYTES = 5
DENSE = 1024  # terms scored as dense columns
TOGETHER = 16  # documents scored at once
ROUGH = 1e-4  # more than single precision can lose in a sum of DENSE products of unit vectors
ADDERS = 8


def block_terms(block: W.Block, prints: W.Fingerprints) -> tuple[np.ndarray, np.ndarray]:
    """Term fingerprints and their texts, one per occurrence."""
    data = W.LOWER[block.data]
    start, end, text = block.words(W.LETTERS)
    sums = prints.prefix(data)
    long = end - start > STEM_BYTES
    stems = W.mix(prints.spans(sums, start[long], start[long] + STEM_BYTES) + np.uint64(1))
    return np.concatenate([prints.spans(sums, start, end), stems]), np.concatenate([text, text[long]])


class ExampleIndex:
    """Examples as unit vectors over all their terms.  Its size is bounded by the sample.

    Terms that stand in the most examples are scored as dense columns in single precision, the
    others through posting lists; whatever may then be among the k best is scored again in double precision.
    """

    def __init__(self, ids: list, labels: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, prior: float, terms: int):
        self.ids, self.labels, self.weights, self.prior, self.terms = ids, labels.astype(float), weights, prior, terms
        self.row_at = np.concatenate([[0], np.cumsum([len(t) for t, _ in vectors])]).astype(np.int64)
        self.row_term = np.concatenate([t for t, _ in vectors] or [np.zeros(0)]).astype(np.int32)
        self.row_value = np.concatenate([w for _, w in vectors] or [np.zeros(0)])
        self.columns: tuple | None = None

    def _columns(self) -> tuple:
        """Dense columns of the common terms and posting lists of all terms; built where they are used."""
        if self.columns is None:
            example = np.repeat(np.arange(len(self.ids), dtype=np.int32), np.diff(self.row_at))
            spread = np.bincount(self.row_term, minlength=self.terms)
            common = np.argsort(-spread, kind="stable")[:DENSE]
            column = np.full(self.terms, -1, np.int32)
            column[common] = np.arange(len(common))
            dense = np.zeros((len(common), len(self.ids)), np.float32)
            in_dense = column[self.row_term] >= 0
            dense[column[self.row_term[in_dense]], example[in_dense]] = self.row_value[in_dense]
            by_term = np.argsort(self.row_term, kind="stable")
            post_at = np.concatenate([[0], np.cumsum(spread)])
            self.columns = column, dense, post_at, example[by_term], self.row_value[by_term]
            self.blank = np.zeros(self.terms)  # a query's weights while it is scored
        return self.columns

    def rough(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Cosines of queries with all examples, to within ``ROUGH``."""
        column, dense, post_at, example, value = self._columns()
        n = len(self.ids)
        term = np.concatenate([t for t, _ in queries])
        weight = np.concatenate([w for _, w in queries])
        query = np.repeat(np.arange(len(queries)), [len(t) for t, _ in queries])
        at = column[term]
        common = at >= 0
        wide = np.zeros((len(queries), len(dense)), np.float32)
        wide[query[common], at[common]] = weight[common]
        scores = (wide @ dense).astype(float)
        # one query at a time, so that its postings stay in the cache
        term, weight, cut = term[~common], weight[~common], np.searchsorted(query[~common], np.arange(len(queries) + 1))
        first, size = post_at[term], post_at[term + 1] - post_at[term]
        for i, row in enumerate(scores):
            own = slice(cut[i], cut[i + 1])
            ends = np.cumsum(size[own])
            post = np.repeat(first[own] - ends + size[own], size[own])
            post += np.arange(len(post))
            product = np.repeat(weight[own], size[own])
            product *= value[post]
            row += np.bincount(example[post], product, minlength=n)
        return scores

    def exact(self, examples: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        rows = [slice(self.row_at[e], self.row_at[e + 1]) for e in examples]
        size = self.row_at[examples + 1] - self.row_at[examples]
        own = self.blank
        own[terms] = weights
        product = own[np.concatenate([self.row_term[r] for r in rows])]
        product *= np.concatenate([self.row_value[r] for r in rows])
        # products with terms the query lacks are zeros and leave the sums as they are
        out = np.bincount(np.repeat(np.arange(len(examples)), size), product, minlength=len(examples))
        own[terms] = 0.0
        return out

    def nearest_of(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per query (terms in order, weights), the numbers and cosines of the k most similar examples with a positive cosine."""
        out: list[tuple[np.ndarray, np.ndarray]] = []
        n = len(self.ids)
        for first in range(0, len(queries), TOGETHER):
            own = queries[first : first + TOGETHER]
            if not n:
                out += [(np.zeros(0, np.int64), np.zeros(0))] * len(own)
                continue
            for (terms, weights), scores in zip(own, self.rough(own)):
                least = np.partition(scores, n - k)[n - k] - 2 * ROUGH if n > k else 0.0
                found = np.flatnonzero((scores >= least) & (scores > 0))
                cosines = self.exact(found, terms, weights) if len(found) else np.zeros(0)
                top = np.lexsort((found, -cosines))[:k]
                out.append((found[top], cosines[top]))
        return out

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: object = None) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest examples of one query, without the example of the id ``skip``."""
        found, cosines = self.nearest_of([(terms, weights)], k + 1)[0]
        return self.without(found, cosines, k, skip)

    def without(self, found: np.ndarray, cosines: np.ndarray, k: int, skip: object) -> tuple[np.ndarray, np.ndarray]:
        """The first k of k + 1 neighbours that are not the example of the id ``skip``."""
        keep = np.array([skip is None or self.ids[e] != skip for e in found.tolist()], bool)
        return found[keep][:k], cosines[keep][:k]

    def vote(self, examples: np.ndarray, cosines: np.ndarray, inertia: float) -> float:
        power = self.weights[examples] * cosines**2
        return float((inertia * self.prior + power @ self.labels[examples]) / (inertia + power.sum()))


def _unit(terms: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    w = (1 + np.log(counts)) * idf[terms]
    size = np.sqrt(w @ w)
    return w / size if size > 0 else w


def _vocabulary(docs: DataFrame, sample: DataFrame, sizes: dict[int, int], chi2: float, min_docs: int) -> np.ndarray:
    """The terms of the sampled documents, sorted; without ``chi2`` and ``min_docs``, all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = W.Fingerprints()
        for batch in batches:
            label = batch.column(0).to_numpy()
            for block in W.blocks(batch.column(1)):
                terms, text = block_terms(block, prints)
                own = W.mix(text.astype(np.uint64) + np.uint64(1))
                _, first = np.unique(terms ^ own, return_index=True)
                term, which = np.unique(terms[first], return_inverse=True)
                toxic = np.bincount(which, label[block.first + text[first]], minlength=len(term)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(toxic), pa.array(np.bincount(which, minlength=len(term)))], names=["term", "a", "n"])

    n1, n0 = float(sizes.get(1, 0)), float(sizes.get(0, 0))
    counted = docs.join(F.broadcast(sample), docs["doc_id"] == sample["id"]).select("label", "text").mapInArrow(run, "term long, a long, n long")
    sums = counted.groupBy("term").agg(F.sum("a").alias("a"), F.sum("n").alias("n")).filter(F.col("n") >= min_docs)
    if chi2 and n1 and n0:
        stat = F.expr(f"{n1 + n0} * pow(a * ({n0} - (n - a)) - (n - a) * ({n1} - a), 2) / (n * ({n1 + n0} - n) * {n1} * {n0})")
        sums = sums.filter(f"n < {n1 + n0}").filter(stat >= chi2)
    terms = sums.select("term").toArrow().column(0)  # bounded by the sample
    return np.sort(terms.to_numpy().view(np.uint64))


def _term_counts(column: pa.Array, vocabulary: np.ndarray) -> Iterator[tuple[W.Block, np.ndarray, np.ndarray, np.ndarray]]:
    """(block, cut, terms, counts): text i of the block has the vocabulary terms cut[i] to cut[i + 1], in order."""
    prints, m = W.Fingerprints(), max(1, len(vocabulary))
    for block in W.blocks(column):
        terms, text = block_terms(block, prints)
        term, which = np.unique(terms, return_inverse=True)
        at = np.minimum(np.searchsorted(vocabulary, term), m - 1)
        known = vocabulary[at] == term if len(vocabulary) else np.zeros(len(term), bool)
        hit = known[which]
        key, count = np.unique(text[hit] * m + at[which[hit]], return_counts=True)
        yield block, np.searchsorted(key, np.arange(block.n + 1) * m), (key % m).astype(np.int32), count.astype(np.int32)


def _frequencies(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """How many documents hold each term, and how many documents there are."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        total = np.zeros(len(vocabulary) + 1, np.int64)
        for batch in batches:
            total[-1] += batch.num_rows
            for _, _, terms, _ in _term_counts(batch.column(0), vocabulary):
                np.add.at(total, terms, 1)
        yield pa.RecordBatch.from_arrays([pa.array([squeeze(total)], pa.binary())], names=["n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value) + 1, np.int64)
        for batch in batches:
            for blob in batch.column(0):
                total += unsqueeze(blob.as_py(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([squeeze(total)], pa.binary())], names=["n"])

    parts = docs.select("text").mapInArrow(count, "n binary").repartition(ADDERS).mapInArrow(add, "n binary").collect()
    total = np.sum([unsqueeze(bytes(r.n), np.int64) for r in parts], axis=0) if parts else np.zeros(len(vocabulary) + 1, np.int64)
    return total[:-1], int(total[-1])


def score(docs: DataFrame, labels: DataFrame, teach: Callable[[str], Column], label: str = "toxic", max_examples: int = 6000, chi2: float = 0.0, min_docs: int = 1, k: int = 15, inertia: float = 0.05) -> DataFrame:
    """(doc_id, score, predicted, evidence) of every document; evidence holds the ids of the three nearest examples.

    ``max_examples`` bounds the example store per class.  All terms of the stored examples are used unless
    ``chi2`` asks for a least difference between the classes or ``min_docs`` for a least number of examples.
    """
    known = labels.filter(teach("doc_id")).filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("label"))
    known = cut_lineage(known.dropDuplicates(["id"]))
    totals = {r.label: r.n for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    sample = cut_lineage(first_rows(known, ["label"], [F.xxhash64("id"), "id"], max_examples))
    sizes = {r.label: r.n for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = totals.get(1, 0) / max(1, sum(totals.values()))
    vocabulary = _vocabulary(docs, sample, sizes, chi2, min_docs)
    frequency, n_docs = _frequencies(docs, vocabulary)
    idf = np.log(1 + n_docs / np.maximum(frequency, 1))
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, cut, terms, counts in _term_counts(batch.column(2), held.value):
                own = [slice(a, b) for a, b in zip(cut[:-1], cut[1:])]
                blobs = [pa.array([x[o].tobytes() for o in own], pa.binary()) for x in (terms, counts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.n), batch.column(1).slice(block.first, block.n), *blobs], names=["id", "label", "terms", "counts"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    given = docs.join(F.broadcast(sample), docs["doc_id"] == sample["id"]).select("id", "label", "text").mapInArrow(examples, f"id {kind}, label int, terms binary, counts binary")
    rows = given.dropDuplicates(["id"]).orderBy("id").toArrow()  # bounded by the sample
    vectors = []
    for t, n in zip(rows["terms"], rows["counts"]):
        t = np.frombuffer(t.as_py(), np.int32)
        vectors.append((t, _unit(t, np.frombuffer(n.as_py(), np.int32), idf)))
    share = {c: totals[c] / sizes[c] for c in sizes}
    middle = sum(totals.values()) / max(1, sum(sizes.values()))
    marks = np.array(rows["label"].to_pylist(), np.int64)
    index = ExampleIndex(rows["id"].to_pylist(), marks, vectors, np.array([share[c] / middle for c in marks.tolist()]), prior, len(vocabulary))
    shared = docs.sparkSession.sparkContext.broadcast((index, idf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, idf = shared.value
        own = set(index.ids)
        seen: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            ids = batch.column(0).to_pylist()
            votes, evidence = [], []
            for block, cut, terms, counts in _term_counts(batch.column(1), held.value):
                parts = [slice(a, b) for a, b in zip(cut[:-1], cut[1:])]
                keys = [terms[p].tobytes() + counts[p].tobytes() for p in parts]
                if len(seen) > 5_000:
                    seen.clear()
                fresh = {key: p for key, p in zip(keys, parts) if key and key not in seen}
                seen |= zip(fresh, index.nearest_of([(terms[p], _unit(terms[p], counts[p], idf)) for p in fresh.values()], k + 1))
                for doc_id, key in zip(ids[block.first : block.first + block.n], keys):
                    found, cosines = seen[key] if key else (np.zeros(0, np.int64), np.zeros(0))
                    found, cosines = index.without(found, cosines, k, doc_id if doc_id in own else None)
                    votes.append(index.vote(found, cosines, inertia))
                    evidence.append([index.ids[e] for e in found[:3]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(votes, pa.float64()), pa.array(evidence, pa.list_(batch.schema.field(0).type))], names=["doc_id", "vote", "evidence"])

    voted = cut_lineage(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, vote double, evidence array<{kind}>"))
    bins = voted.join(known, voted["doc_id"] == known["id"]).groupBy(F.round("vote", 3).alias("v")).agg(F.sum("label").alias("y"), F.count(F.lit(1)).alias("n")).orderBy("v").collect()  # at most 1,001
    if bins:
        knots, values = isotonic(np.array([r.v for r in bins]), np.array([r.y for r in bins], float), np.array([r.n for r in bins], float))
    else:
        knots, values = np.array([0.0]), np.array([0.0])

    def calibrate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = np.interp(batch.column(1).to_numpy(), knots, values)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value), batch.column(2)], names=["doc_id", "score", "evidence"])

    out = voted.mapInArrow(calibrate, f"doc_id {kind}, score double, evidence array<{kind}>")
    return out.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
