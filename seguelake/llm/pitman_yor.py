"""A hierarchical Pitman-Yor language model over words.

A word is predicted in the restaurant of the word before it.  Previous words are
hashed to ``1 << FINE`` restaurants; those that share the first ``COARSE`` bits
share a parent restaurant, and all parents share the root, whose base is uniform
over the known words and one unknown word.  Each table of a restaurant sends one
customer to its parent.

Seating is sampled by Gibbs, dish by dish: the number of tables of a dish with c
customers is drawn from its conditional, generalised Stirling numbers times powers
of the new-table weight, for c up to ``EXACT``; further customers of larger dishes
are seated in growing batches.  All restaurants that serve one word meet in one
slice of the vocabulary, so parents' probabilities are current within a sweep.  The
totals of a restaurant span slices: before each sweep they are added up over all slices.
Draws follow the seed, so a slice comes back to its seating by repeating its former
sweeps under their totals, and no seating is stored.  Counts less discounts are averaged
over the sweeps after burn-in, which gives averaged predictive probabilities that
sum to one.

Documents are dealt into blocks; a block sends each slice its (word, restaurant)
counts once, whatever their number, and gets its own pairs' statistics back, so no
text or vocabulary is broadcast or gathered.

Nulls and odd cases: null and empty texts are an end token; null ids learn like
others and come back as null; repeated rows are learned and scored as often as they
stand; without training documents every token is unknown; empty tables give empty
results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seguelake.llm import words as W
from seguelake.llm.lz_dedup import BLOCK_ROWS, NO_ID, opened, pack_documents, packed, unpacked
from seguelake.session import cut_lineage

FINE, COARSE = 14, 7
DISCOUNT = (0.6, 0.75, 0.85)  # root, parents, restaurants
STRENGTH = (1.0, 5.0, 5.0)
EXACT = 40
ADDERS = 32
# where the totals of a seating are cut: customers and tables of restaurants, customers and tables of parents, sums of the root
CUTS = np.cumsum([1 << FINE, 1 << FINE, 1 << COARSE, 1 << COARSE])
END, BEGIN = np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC949C7DEFE4B1D37)


def squeeze(values: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.dtype.itemsize).T)
    return zstandard.compress(planes.tobytes(), 1)


def unsqueeze(blob: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


class Tokens:
    """Tokens of a block of documents, their distinct words and (word, restaurant) pairs in order."""

    def __init__(self, ids: np.ndarray, texts: list[pa.Array], teach: Callable[[int | None], bool]):
        prints, words, docs, first = W.Fingerprints(), [], [], 0
        for column in texts:
            for block in W.blocks(column):
                data = W.LOWER[block.data]
                start, end, text = block.words()
                print_ = prints.spans(prints.prefix(data), start, end)
                at = np.searchsorted(text, np.arange(block.n), "right")
                words.append(np.insert(print_, at, END))
                docs.append(np.insert(text, at, np.arange(block.n)) + first)
                first += block.n
        word = np.concatenate(words or [np.zeros(0, np.uint64)])
        self.doc = np.concatenate(docs or [np.zeros(0, np.int64)])
        self.n = first
        before = np.append(BEGIN, word[:-1])[: len(word)]
        before[np.append(True, self.doc[1:] != self.doc[:-1])[: len(word)]] = BEGIN
        place = W.mix(before) >> np.uint64(64 - FINE)
        self.taught = np.array([teach(None if i == NO_ID else i) for i in ids.tolist()], bool)
        self.words, rank = np.unique(word, return_inverse=True)
        pair = rank.astype(np.uint64) << np.uint64(FINE) | place
        self.pairs, self.pair_of = np.unique(pair, return_inverse=True)
        self.word_of = rank
        self.counts = np.bincount(self.pair_of, self.taught[self.doc] if len(self.doc) else None, minlength=len(self.pairs)).astype(np.uint32)


def stirling_logs(discount: float) -> np.ndarray:
    """Logs of generalised Stirling numbers S(c, t) for c, t up to EXACT."""
    s = np.full((EXACT + 1, EXACT + 1), -np.inf)
    s[0, 0] = 0.0
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(EXACT):
            t = np.arange(EXACT + 1)
            stay = s[c] + np.log(np.maximum(c - discount * t, 0))
            s[c + 1] = np.logaddexp(np.append(-np.inf, s[c][:-1]), stay)
    return s


def seat(customers: np.ndarray, weight: np.ndarray, logs: np.ndarray, discount: float, draw: np.random.Generator) -> np.ndarray:
    """Draw the number of tables of each dish given its customers and the weight of a new table."""
    tables = np.minimum(customers, 1).astype(np.int64)
    log_weight = np.log(np.maximum(weight, 1e-300))
    small = np.minimum(customers, EXACT)
    order = np.argsort(small, kind="stable")
    cut = np.searchsorted(small[order], np.arange(2, EXACT + 2))
    for c in range(2, EXACT + 1):
        own = order[cut[c - 2] : cut[c - 1]]
        if len(own):
            t = np.arange(1, c + 1)
            odds = logs[c, 1 : c + 1] + log_weight[own, None] * t
            odds = np.cumsum(np.exp(odds - odds.max(axis=1, keepdims=True)), axis=1)
            tables[own] = 1 + (draw.random(len(own))[:, None] * odds[:, -1:] > odds).sum(axis=1)
    big = np.flatnonzero(customers > EXACT)
    seated = np.full(len(big), EXACT, np.int64)
    while len(big):
        batch = np.minimum(np.maximum(1, seated // 10), customers[big] - seated)
        fresh = weight[big] / (weight[big] + seated - discount * tables[big])
        tables[big] += draw.binomial(batch, fresh)
        seated += batch
        more = seated < customers[big]
        big, seated = big[more], seated[more]
    return tables


def sample(pair: np.ndarray, count: np.ndarray, n_words: int, totals: list[np.ndarray], burn: int, seed: int) -> dict[str, np.ndarray]:
    """Seating of one slice after a sweep for each of ``totals``; ``pair`` is word << FINE | restaurant, sorted.

    ``totals`` holds, for each sweep, what all slices together had before it.  Returned are this slice's
    own totals now and its statistics averaged over the sweeps after ``burn``.
    """
    word, place = (pair >> np.uint64(FINE)).astype(np.int64), (pair & np.uint64((1 << FINE) - 1)).astype(np.int64)
    parent = pair >> np.uint64(FINE - COARSE)
    head = np.flatnonzero(np.append(True, parent[1:] != parent[:-1])) if len(pair) else np.zeros(0, np.int64)
    up = np.cumsum(np.append(True, parent[1:] != parent[:-1])) - 1 if len(pair) else np.zeros(0, np.int64)
    p_word, p_place = word[head], place[head] >> (FINE - COARSE)
    customers = count.astype(np.int64)
    (d0, d1, d2), (s0, s1, s2) = DISCOUNT, STRENGTH
    logs = [stirling_logs(d) for d in DISCOUNT]
    draw = np.random.default_rng(seed)
    t2 = np.minimum(customers, 1)
    c1 = np.add.reduceat(t2, head) if len(head) else t2
    t1 = np.minimum(c1, 1)
    c0 = np.bincount(p_word, t1, minlength=n_words).astype(np.int64)
    t0 = np.minimum(c0, 1)
    out = {k: np.zeros(len(v)) for k, v in (("a2", pair), ("a1", head), ("a0", c0))}
    for sweep, total in enumerate(totals):
        _, all_t2, all_c1, all_t1, (all_c0, all_t0, known, _) = np.split(total, CUTS)
        fresh = (s0 + d0 * all_t0) / (known + 1)
        root = (c0 - d0 * t0 + fresh) / (s0 + all_c0)
        mid = (c1 - d1 * t1 + (s1 + d1 * all_t1[p_place]) * root[p_word]) / (s1 + all_c1[p_place])
        t2 = seat(customers, (s2 + d2 * all_t2[place]) * mid[up], logs[2], d2, draw)
        c1 = np.add.reduceat(t2, head) if len(head) else t2
        t1 = seat(c1, (s1 + d1 * all_t1[p_place]) * root[p_word], logs[1], d1, draw)
        c0 = np.bincount(p_word, t1, minlength=n_words).astype(np.int64)
        t0 = seat(c0, np.full(len(c0), fresh), logs[0], d0, draw)
        if sweep >= burn:
            share = 1 / (len(totals) - burn)
            for k, v in (("a2", customers - d2 * t2), ("a1", c1 - d1 * t1), ("a0", c0 - d0 * t0)):
                out[k] += share * v
    sums = [
        np.bincount(place, customers, minlength=1 << FINE), np.bincount(place, t2, minlength=1 << FINE),
        np.bincount(p_place, c1, minlength=1 << COARSE), np.bincount(p_place, t1, minlength=1 << COARSE),
        [float(c0.sum()), float(t0.sum()), float((c0 > 0).sum()), float(customers.sum())],
    ]
    return {"a2": out["a2"], "a1": out["a1"][up] if len(up) else out["a1"], "a0": out["a0"], "totals": np.concatenate(sums), "words": np.bincount(word, customers, minlength=n_words)}


def score(docs: DataFrame, teach: Callable[[int | None], bool], sweeps: int = 6, burn: int = 3, block_rows: int = BLOCK_ROWS, seed: int = 5) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score), in log10, of every document."""
    blocks = max(1, -(-docs.count() // block_rows))
    slices = blocks
    held = pack_documents(docs, blocks)

    def publish(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        tokens = Tokens(*opened(rows.body), teach)
        part = ((tokens.words >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)).astype(np.int64)
        cut = np.searchsorted(part, np.arange(slices + 1))
        pair_word = (tokens.pairs >> np.uint64(FINE)).astype(np.int64)
        edge = np.searchsorted(pair_word, cut)
        out = []
        for s in np.flatnonzero(np.diff(cut)):
            own = slice(edge[s], edge[s + 1])
            local = tokens.pairs[own] - (np.uint64(cut[s]) << np.uint64(FINE))
            out.append((int(s), key[0], packed(tokens.words[cut[s] : cut[s + 1]]), packed(local), squeeze(tokens.counts[own])))
        return pd.DataFrame(out, columns=["slice", "block", "words", "pairs", "counts"])

    def in_slice(all_words: np.ndarray, words: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """Pairs of a block with its words numbered as in the slice."""
        to = np.searchsorted(all_words, words).astype(np.uint64)
        return to[(pairs >> np.uint64(FINE)).astype(np.int64)] << np.uint64(FINE) | pairs & np.uint64((1 << FINE) - 1)

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        names = [unpacked(b) for b in rows.words]
        all_words = np.unique(np.concatenate(names))
        mine = [in_slice(all_words, own, unpacked(pairs)) for own, pairs in zip(names, rows.pairs)]
        pair, which = np.unique(np.concatenate(mine), return_inverse=True)
        count = np.bincount(which, np.concatenate([unsqueeze(b, np.uint32) for b in rows.counts]), minlength=len(pair)).astype(np.int64)
        return pd.DataFrame({"slice": [key[0]], "blocks": [rows.block.to_numpy()], "words": [list(rows.words)], "pairs": [list(rows.pairs)], "all_words": [packed(all_words)], "pair": [packed(pair)], "count": [squeeze(count)]})

    spark = docs.sparkSession
    index = held.groupBy("block").applyInPandas(publish, "slice int, block int, words binary, pairs binary, counts binary")
    # a slice is a row, so the rounds below read it without a shuffle
    merged = cut_lineage(index.groupBy("slice").applyInPandas(merge, "slice int, blocks array<int>, words array<binary>, pairs array<binary>, all_words binary, pair binary, count binary"))
    size = int(CUTS[-1]) + 4

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for blob in batch.column(0):
                total += unsqueeze(blob.as_py(), np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([squeeze(total)], pa.binary())], names=["totals"])

    def seated(so_far: list[np.ndarray]) -> np.ndarray:
        """Totals over all slices after a sweep for each of ``so_far``."""
        sent = spark.sparkContext.broadcast(so_far)  # a row of fixed size per sweep

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for slice_, all_words, pair, count in zip(*batch.columns):
                    n_words = len(unpacked(all_words.as_py()))
                    got = sample(unpacked(pair.as_py()), unsqueeze(count.as_py(), np.int64), n_words, sent.value, burn, seed + 1000 * slice_.as_py())
                    yield pa.RecordBatch.from_arrays([pa.array([squeeze(got["totals"])], pa.binary())], names=["totals"])

        own = merged.select("slice", "all_words", "pair", "count").mapInArrow(run, "totals binary")
        parts = own.repartition(ADDERS).mapInArrow(add, "totals binary").collect()  # ADDERS rows of fixed size
        return np.sum([unsqueeze(bytes(r.totals), np.float64) for r in parts], axis=0) if parts else np.zeros(size)

    history = [seated([])]
    for _ in range(sweeps):
        history.append(seated(history))
    before = spark.sparkContext.broadcast(history[:-1])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 4)
        for batch in batches:
            for row in range(batch.num_rows):
                slice_, blocks, words, pairs, all_words, pair, count = (column[row].as_py() for column in batch.columns)
                all_words, pair = unpacked(all_words), unpacked(pair)
                got = sample(pair, unsqueeze(count, np.int64), len(all_words), before.value, burn, seed + 1000 * slice_)
                out = []
                for block, own, local in zip(blocks, words, pairs):
                    own = unpacked(own)
                    w, p = np.searchsorted(all_words, own), np.searchsorted(pair, in_slice(all_words, own, unpacked(local)))
                    out.append((block, slice_, *[squeeze(got[k][at].astype(kind)) for k, at, kind in (("a2", p, np.float32), ("a1", p, np.float32), ("a0", w, np.float32), ("words", w, np.int64))]))
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out), kinds)], names=["block", "slice", "a2", "a1", "a0", "words"])

    learned = merged.mapInArrow(answer, "block int, slice int, a2 binary, a1 binary, a0 binary, words binary")
    # what was averaged over sweeps has the average of their totals
    n2, t2, n1, t1, (n0, t0, types, train) = np.split(np.mean(history[burn + 1 :], axis=0), CUTS)
    shared = spark.sparkContext.broadcast((n2, t2, n1, t1))

    def judge(key: tuple, texts: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        ids, columns = opened(texts.body)
        tokens = Tokens(ids, columns, teach)
        answers = answers.sort_values("slice")
        (d0, d1, d2), (s0, s1, s2) = DISCOUNT, STRENGTH
        n2, t2, n1, t1 = shared.value

        def joined(name: str, kind: type) -> np.ndarray:
            return np.concatenate([unsqueeze(b, kind) for b in answers[name]]).astype(float) if len(answers) else np.zeros(0)

        place = (tokens.pairs & np.uint64((1 << FINE) - 1)).astype(np.int64)
        word = (tokens.pairs >> np.uint64(FINE)).astype(np.int64)
        parent = place >> (FINE - COARSE)
        count = joined("words", np.int64)
        root = (joined("a0", np.float32) + (s0 + d0 * t0) / (types + 1)) / (s0 + n0)
        mid = (joined("a1", np.float32) + (s1 + d1 * t1[parent]) * root[word]) / (s1 + n1[parent])
        leaf = np.log10((joined("a2", np.float32) + (s2 + d2 * t2[place]) * mid) / (s2 + n2[place]))
        base = np.log10((count + 0.5) / (train + 0.5 * (types + 1)))
        named = pd.array([None if i == NO_ID else i for i in ids.tolist()], "Int64")
        add_up = lambda v: np.bincount(tokens.doc, v, minlength=tokens.n)
        return pd.DataFrame(
            {
                "doc_id": named,
                "n_tokens": np.bincount(tokens.doc, minlength=tokens.n),
                "n_known": add_up(count[tokens.word_of] > 0).astype(np.int64),
                "train_tokens": np.full(tokens.n, int(train)),
                "base_score": add_up(base[tokens.word_of]),
                "score": add_up(leaf[tokens.pair_of]),
            }
        )

    kind = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return held.groupBy("block").cogroup(learned.groupBy("block")).applyInPandas(judge, kind)


def perplexity(scored: DataFrame) -> DataFrame:
    """Perplexity per token of a table of scores, of the model and of the base."""
    power = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scored.agg(power("score").alias("perplexity"), power("base_score").alias("base_perplexity"))
