"""Substring deduplication by relative Lempel-Ziv parsing.

Documents are dealt into reference blocks by a hash of their id.  Each block is
indexed by the fingerprints of its 13-word windows, with the smallest id that
starts each.  Every block sends its index, cut into slices of the fingerprint
space, to the slice's task, which answers each block with the fingerprints that a
smaller id of another block starts.  With those answers a block's documents are
parsed: a factor runs as long as its consecutive windows each stand in a reference;
windows across a border between factors are looked up like all others, so two
factors that touch are joined only where the text allows it.  The words under
factors are removed.

What travels is one sorted, packed fingerprint list per block and slice: a window
that fills a third of all documents is sent once per block.  Texts are packed too.

Nulls and odd cases: null and empty texts have no words; null ids come before all
others; equal ids do not precede one another, so repeated rows keep or lose the
same words; texts shorter than a window lose nothing; periodic texts are handled
like others; other columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seguelake.llm import words as W

WINDOW = 13
BLOCK_ROWS = 4000
NO_ID = np.iinfo(np.int64).min


def packed(values: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as differences, byte planes apart, compressed."""
    steps = np.diff(values, prepend=values.dtype.type(0)).view(np.uint8).reshape(-1, 8).T
    return zstandard.compress(np.ascontiguousarray(steps).tobytes(), 1)


def unpacked(blob: bytes, kind: type = np.uint64) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(kind).reshape(-1), dtype=kind)


def pack_documents(docs: DataFrame, blocks: int) -> DataFrame:
    """(block, body): the documents of each block, several to a row, as compressed Arrow batches."""
    rows = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(3)
        for batch in batches:
            at = np.argsort(batch.column(0).to_numpy(), kind="stable")
            if not len(at):
                continue
            sorted_ = batch.take(pa.array(at))
            block = sorted_.column(0).to_numpy()
            cut = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            bodies = []
            for a, b in zip(cut, np.append(cut[1:], len(block))):
                part = pa.RecordBatch.from_arrays([pa.concat_arrays([sorted_.column(i).slice(a, b - a)]) for i in (1, 2)], names=["doc_id", "text"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema) as out:
                    out.write_batch(part)
                bodies.append(packer.compress(sink.getvalue().to_pybytes()))
            yield pa.RecordBatch.from_arrays([pa.array(block[cut], pa.int32()), pa.array(bodies, pa.binary())], names=["block", "body"])

    return rows.mapInArrow(run, "block int, body binary")


def opened(bodies: pd.Series) -> tuple[np.ndarray, list[pa.Array]]:
    """Ids (null as the smallest number) and text columns of packed rows."""
    ids, texts = [], []
    for body in bodies:
        table = pa.ipc.open_stream(zstandard.decompress(body)).read_all()
        ids.append(table.column("doc_id").fill_null(int(NO_ID)).to_numpy())
        texts.append(table.column("text").combine_chunks())
    return np.concatenate(ids) if ids else np.zeros(0, np.int64), texts


class Parsed:
    """Words and windows of the documents of one reference block."""

    def __init__(self, ids: np.ndarray, texts: list[pa.Array], window: int):
        prints = W.Fingerprints()
        first = words_before = 0
        self.cuts, grams, owners, starts, word_docs = [], [], [], [], []
        for column in texts:
            for block in W.blocks(column):
                start, end, text = block.words()
                gram, at = W.grams(prints.spans(prints.prefix(block.data), start, end), text, window)
                grams.append(gram)
                owners.append(text[at] + first)
                starts.append(at + words_before)
                self.cuts.append((block, start, end))
                word_docs.append(text + first)
                words_before += len(start)
                first += block.n
        none = [np.zeros(0, np.int64)]
        self.ids, self.n = ids, first
        self.gram = np.concatenate(grams or [np.zeros(0, np.uint64)])
        self.owner, self.start = np.concatenate(owners or none), np.concatenate(starts or none)
        self.word_doc = np.concatenate(word_docs or none)

    def index(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct window fingerprints in order, and the smallest id that starts each."""
        order = np.lexsort((self.ids[self.owner], self.gram)) if len(self.gram) else np.zeros(0, np.int64)
        gram = self.gram[order]
        head = np.append(True, gram[1:] != gram[:-1]) if len(gram) else np.zeros(0, bool)
        return gram[head], self.ids[self.owner][order][head]

    def factors(self, keys: np.ndarray, least: np.ndarray, earlier: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and end (in words of the block) of the factors that repeat an earlier document.

        ``least`` is the smallest id of this block per key; ``earlier`` lists the keys that another block starts before that.
        """
        slot = np.searchsorted(keys, self.gram)
        known = np.isin(keys, earlier, assume_unique=True)[slot] if len(keys) else np.zeros(0, bool)
        at = np.flatnonzero(known | (least[slot] < self.ids[self.owner]) if len(keys) else known)
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        runs_on = (self.start[at][1:] == self.start[at][:-1] + 1) & (self.owner[at][1:] == self.owner[at][:-1])
        head = np.append(True, ~runs_on)
        tail = np.append(~runs_on, True)
        return self.start[at][head], self.start[at][tail] + window

    def kept(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Words, removed words and the digest of the kept words of each document."""
        cover = np.zeros(len(self.word_doc) + 1, np.int64)
        np.add.at(cover, start, 1)
        np.add.at(cover, end, -1)
        gone = np.cumsum(cover)[:-1] > 0
        digests, before = [], 0
        for block, a, b in self.cuts:
            raw, mine = block.data.tobytes(), gone[before : before + len(a)]
            cut = np.searchsorted(a, np.append(block.starts, len(raw) + 1))
            keep = ~mine
            for i in range(block.n):
                w = slice(cut[i], cut[i + 1])
                live = keep[w]
                digests.append(hashlib.sha256(b" ".join([raw[x:y] for x, y in zip(a[w][live].tolist(), b[w][live].tolist())])).hexdigest())
            before += len(a)
        return np.bincount(self.word_doc, minlength=self.n), np.bincount(self.word_doc[gone], minlength=self.n), digests


def deduplicate(docs: DataFrame, window: int = WINDOW, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document; ``block_rows`` is the aimed-at size of a reference block."""
    blocks = max(1, -(-docs.count() // block_rows))
    slices = blocks
    held = pack_documents(docs, blocks)

    def publish(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ids, texts = opened(rows.body)
        keys, least = Parsed(ids, texts, window).index()
        # the upper bits choose the slice, so each slice is a run of the sorted keys
        part = ((keys >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)).astype(np.int64)
        cut = np.searchsorted(part, np.arange(slices + 1))
        names, rank = np.unique(least, return_inverse=True)
        out = []
        for s in np.flatnonzero(np.diff(cut)):
            own = slice(cut[s], cut[s + 1])
            mine, pos = np.unique(rank[own], return_inverse=True)
            out.append((int(s), key[0], packed(keys[own]), packed(names[mine]), zstandard.compress(pos.astype(np.uint16 if len(mine) <= 1 << 16 else np.uint32).tobytes(), 1)))
        return pd.DataFrame(out, columns=["slice", "block", "keys", "names", "least"])

    def answer(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        keys, least, source = [], [], []
        for r in rows.itertuples():
            k, names = unpacked(r.keys), unpacked(r.names, np.int64)
            raw = zstandard.decompress(r.least)
            keys.append(k)
            least.append(names[np.frombuffer(raw, np.uint16 if len(raw) == 2 * len(k) else np.uint32)])
            source.append(np.full(len(k), r.block, np.int32))
        keys, least, source = np.concatenate(keys), np.concatenate(least), np.concatenate(source)
        order = np.argsort(keys, kind="stable")
        keys, least, source = keys[order], least[order], source[order]
        head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        first = np.repeat(np.minimum.reduceat(least, head), np.diff(np.append(head, len(keys))))
        late = first < least
        keys, source = keys[late], source[late]
        by = np.argsort(source, kind="stable")
        keys, source = keys[by], source[by]
        cut = np.flatnonzero(np.append(True, source[1:] != source[:-1])) if len(source) else np.zeros(0, np.int64)
        out = [(int(source[a]), packed(keys[a:b])) for a, b in zip(cut, np.append(cut[1:], len(source)))]
        return pd.DataFrame(out, columns=["block", "earlier"])

    def parse(key: tuple, texts: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        ids, columns = opened(texts.body)
        parsed = Parsed(ids, columns, window)
        keys, least = parsed.index()
        earlier = np.sort(np.concatenate([unpacked(e) for e in answers.earlier])) if len(answers) else np.zeros(0, np.uint64)
        n_words, removed, digests = parsed.kept(*parsed.factors(keys, least, earlier, window))
        named = pd.array([None if i == NO_ID else i for i in ids.tolist()], "Int64")
        return pd.DataFrame({"doc_id": named, "n_words": n_words, "n_removed": removed, "kept_sha256": digests})

    index = held.groupBy("block").applyInPandas(publish, "slice int, block int, keys binary, names binary, least binary")
    answers = index.groupBy("slice").applyInPandas(answer, "block int, earlier binary")
    return held.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(parse, "doc_id long, n_words long, n_removed long, kept_sha256 string")
