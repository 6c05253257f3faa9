"""Byte-level BPE in batched numpy merge rounds, and its decoding.

Texts are cut into pieces by character classes over whole blocks of bytes; the
distinct pieces of a block are looked up, and those not met before are merged
together: the symbols of all of them lie in one flat array, every pair of
neighbours has its rank found by binary search over the sorted pair keys, and each
round merges the lowest-ranked pair of every word.  Equal pairs of a word are merged
in one round, left to right, unless the new symbol could take part in a merge of a
lower rank, in which case only the leftmost is.

Token ids travel packed, as little-endian unsigned 32-bit numbers in a binary
column; ``ids_array`` unpacks them.  Decoding looks up each id's bytes; invalid
UTF-8 becomes replacement characters, and unknown ids give nothing.

Nulls and odd cases: null texts count as empty and have no ids; null ids decode to
the empty text; very long texts and words are handled whole; rows and other columns
are independent of each other; empty tables give empty results.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seguelake.llm import words as W

NONE = np.int64(1 << 40)
KEY = np.int64(1 << 24)
CACHED_PIECES = 400_000
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
CODE_POINTS = 0x110000


# White space, and letters and numbers of Unicode 16, which the tokenizers library knows and Python 3.13 does not
WHITE_SPACE = [(0x9, 0xD), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
NEW_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389),
    (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA),
    (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NEW_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    of = {"L": LETTER, "N": NUMBER}
    classes = np.fromiter((of.get(unicodedata.category(chr(c))[0], OTHER) for c in range(CODE_POINTS)), np.uint8, CODE_POINTS)
    for kind, ranges in ((SPACE, WHITE_SPACE), (LETTER, NEW_LETTERS), (NUMBER, NEW_NUMBERS)):
        for first, last in ranges:
            classes[first : last + 1] = kind
    return classes


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in vocabulary files: itself if printable Latin-1, else the next from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shifted = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(shifted)) for b in range(256)]


def classes_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class of the character each byte belongs to, where that character starts)."""
    table = character_classes()
    at = np.arange(len(data))
    if not len(data) or data.max() < 0x80:
        return table[:128][data], at
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32)
    a, b, c, d = (padded[lead + k] for k in range(4))
    code = np.select(
        [a < 0x80, a < 0xE0, a < 0xF0],
        [a, (a & 0x1F) << 6 | b & 0x3F, (a & 0x0F) << 12 | (b & 0x3F) << 6 | c & 0x3F],
        (a & 0x07) << 18 | (b & 0x3F) << 12 | (c & 0x3F) << 6 | d & 0x3F,
    )
    sizes = np.diff(lead, append=len(data))
    return np.repeat(table[np.minimum(code, CODE_POINTS - 1)], sizes), np.repeat(lead, sizes)


def piece_starts(data: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Where the pieces start.  ``borders`` are positions that no piece may cross.

    A piece is a contraction, a run of one class with at most one blank before it, or
    white space; the last character of white space is a piece of its own unless the
    text ends there.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    kind, start_of = classes_of(data)
    hard = np.zeros(n + 1, bool)
    hard[borders[borders <= n]] = True
    hard[[0, n]] = True
    first = np.flatnonzero(hard[:n] | (np.diff(kind, prepend=kind[0]) != 0))
    end = np.append(first[1:], n)
    head = np.zeros(n + 1, bool)
    head[first] = True
    inner = (kind[first] == SPACE) & ~hard[end]
    last = end[inner] - 1
    head[start_of[last]] = True
    head[end[inner][data[last] == 0x20]] = False
    # contractions: ' alone before s, t, m, d, re, ve or ll
    mark = first[(end == first + 1) & (data[first] == 0x27) & head[first] & ~hard[end]]
    padded = np.concatenate([data, np.zeros(2, np.uint8)])
    x, y = padded[mark + 1], padded[mark + 2]
    one = np.isin(x, np.frombuffer(b"stmd", np.uint8))
    two = ((x == 0x72) & (y == 0x65) | (x == 0x76) & (y == 0x65) | (x == 0x6C) & (y == 0x6C)) & ~hard[np.minimum(mark + 2, n)]
    head[mark[one | two] + 1] = False
    head[mark[one] + 2] = True
    head[mark[two] + 3] = True
    return np.flatnonzero(head[:n])


class ByteBpe:
    """Vocabulary, merges and a bounded cache of encoded pieces."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        symbols = byte_symbols()
        value = {s: b for b, s in enumerate(symbols)}
        self.byte_ids = np.array([vocab[s] for s in symbols], np.int64)
        left, right = np.array([vocab[a] for a, _ in merges], np.int64), np.array([vocab[b] for _, b in merges], np.int64)
        self.new = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = left * KEY + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        # a merge is simple if no pair with its new symbol has a lower rank
        lowest = np.full(max(vocab.values()) + 1, NONE)
        np.minimum.at(lowest, left, np.arange(len(merges)))
        np.minimum.at(lowest, right, np.arange(len(merges)))
        self.simple = lowest[self.new] > np.arange(len(merges))
        self.added = {}
        for token in spec["added_tokens"]:
            if token["single_word"] or token["lstrip"] or token["rstrip"]:
                raise ValueError(f"added token {token['content']!r} is matched in a way that is not supported")
            self.added[token["content"].encode()] = token["id"]
        raw = {i: bytes(value[c] for c in t) if all(c in value for c in t) else t.encode() for t, i in vocab.items()}
        raw.update({i: t for t, i in self.added.items()})
        top = max(raw) + 1
        self.sizes = np.array([len(raw.get(i, b"")) for i in range(top)] + [0], np.int64)  # the last stands for unknown ids
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(raw.get(i, b"") for i in range(top)), np.uint8)
        self._clear()

    def _clear(self) -> None:
        self.slots = {t: k for k, t in enumerate(self.added)}
        self.flat = np.fromiter(self.added.values(), np.uint32, len(self.added))
        self.size = np.ones(len(self.added), np.int64)
        self.at = np.arange(len(self.added), dtype=np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``NONE`` where it is never merged."""
        keys = left * KEY + right
        slot = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[slot] == keys, self.ranks[slot], NONE)

    def merge(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words given by their bytes, one after the other, and the number of ids of each; no word is empty."""
        symbol, word = self.byte_ids[data], np.repeat(np.arange(len(sizes)), sizes)
        rank = np.full(len(symbol), NONE)
        same = np.flatnonzero(word[:-1] == word[1:])
        rank[same] = self.rank(symbol[same], symbol[same + 1])
        done = []
        while len(symbol):
            first = np.flatnonzero(np.diff(word, prepend=-1))
            length = np.diff(first, append=len(word))
            best = np.minimum.reduceat(rank, first)
            open_word = best < NONE
            if not open_word.all():
                kept = np.repeat(open_word, length)
                done.append((word[~kept], symbol[~kept]))
                symbol, word, rank, best, length = symbol[kept], word[kept], rank[kept], best[open_word], length[open_word]
                if not len(symbol):
                    break
                first = np.cumsum(length) - length
            hits = np.flatnonzero(rank == np.repeat(best, length))
            owner = word[hits]
            leftmost = np.flatnonzero(np.diff(owner, prepend=-1))  # every open word has a hit
            nth = np.arange(len(hits)) - np.repeat(leftmost, np.diff(leftmost, append=len(hits)))
            hits = hits[self.simple[rank[hits]] | (nth == 0)]
            # in a run of overlapping pairs (x x x) every second one is merged
            broken = np.diff(hits, prepend=-2) != 1
            run = np.flatnonzero(broken)
            hits = hits[(np.arange(len(hits)) - np.repeat(run, np.diff(run, append=len(hits)))) % 2 == 0]
            symbol[hits] = self.new[rank[hits]]
            keep = np.ones(len(symbol), bool)
            keep[hits + 1] = False
            place = np.cumsum(keep) - 1
            changed = place[hits]
            symbol, word, rank = symbol[keep], word[keep], rank[keep]
            changed = np.unique(np.concatenate([changed, changed[changed > 0] - 1]))
            inside = changed[changed + 1 < len(word)]
            inside = inside[word[inside] == word[inside + 1]]
            rank[changed] = NONE
            rank[inside] = self.rank(symbol[inside], symbol[inside + 1])
        if not done:
            return np.zeros(0, np.uint32), np.zeros(len(sizes), np.int64)
        word, symbol = (np.concatenate(x) for x in zip(*done))
        return symbol[np.argsort(word, kind="stable")].astype(np.uint32), np.bincount(word, minlength=len(sizes))

    def _learn(self, pieces: list[bytes]) -> None:
        ids, sizes = self.merge(np.frombuffer(b"".join(pieces), np.uint8), np.fromiter(map(len, pieces), np.int64, len(pieces)))
        at = len(self.flat) + np.cumsum(sizes) - sizes
        known = len(self.size)
        self.slots.update(zip(pieces, range(known, known + len(pieces))))
        self.flat, self.size, self.at = np.concatenate([self.flat, ids]), np.concatenate([self.size, sizes]), np.concatenate([self.at, at])

    def encode(self, block: W.Block) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block and the number of ids of each text."""
        data = block.data
        borders, inside = [np.asarray(block.starts)], []
        raw = data.tobytes()
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                if np.searchsorted(block.starts, at, "right") == np.searchsorted(block.starts, at + len(token) - 1, "right"):
                    borders.append(np.array([at, at + len(token)]))
                    inside.append((at, at + len(token)))
                    at += len(token) - 1
                at = raw.find(token, at + 1)
        start = piece_starts(data, np.concatenate(borders))
        for a, b in inside:
            start = start[(start <= a) | (start >= b)]
        offsets = np.append(start, len(data)).astype(np.int64)
        column = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
        coded = column.dictionary_encode()
        pieces = coded.dictionary.to_pylist()
        new = [p for p in pieces if p not in self.slots]
        if len(self.slots) + len(new) > CACHED_PIECES:
            self._clear()
            new = [p for p in pieces if p not in self.slots]
        if new:
            self._learn(new)
        slot = np.fromiter(map(self.slots.__getitem__, pieces), np.int64, len(pieces))[coded.indices.to_numpy()]
        size, at = self.size[slot], self.at[slot]
        before = np.cumsum(size) - size
        ids = self.flat[np.repeat(at - before, size) + np.arange(int(size.sum()))] if len(size) else np.zeros(0, np.uint32)
        text = np.searchsorted(block.starts, start, "right") - 1
        return ids, block.per_text(text, size).astype(np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of consecutive groups of ids."""
        ids = np.minimum(ids.astype(np.int64), len(self.sizes) - 1)
        size = self.sizes[ids]
        before = np.cumsum(size) - size
        raw = self.bytes[np.repeat(self.starts[ids] - before, size) + np.arange(int(size.sum()))].tobytes() if len(ids) else b""
        cuts = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:])]


@lru_cache(maxsize=1)
def coder(path: str) -> ByteBpe:
    """One per Python worker: its tasks share the loaded tables and the pieces seen."""
    return ByteBpe(path)


def encode(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids) of every row."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(tokenizer)
        for batch in batches:
            for block in W.blocks(batch.column(1)):
                ids, counts = bpe.encode(block)
                offsets = np.concatenate([[0], np.cumsum(counts)]) * 4
                packed = pa.Array.from_buffers(pa.large_binary(), block.n, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.n), pa.array(counts), packed.cast(pa.binary())], names=[key, "n_tokens", "ids"])

    return docs.select(docs[key], docs[text]).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids binary")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """Add ``decoded`` to rows with packed ``ids``."""
    names = encoded.columns
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields], "decoded string"])
    at = names.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(tokenizer)
        for whole in batches:
            for first in range(0, whole.num_rows, 500):
                batch = whole.slice(first, 500)
                packed = [b or b"" for b in batch.column(at).to_pylist()]
                texts = bpe.decode(np.frombuffer(b"".join(packed), "<u4"), np.fromiter((len(b) // 4 for b in packed), np.int64, len(packed)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, "decoded"])

    return encoded.mapInArrow(run, schema)


def ids_array(encoded: DataFrame) -> DataFrame:
    """Packed ``ids`` as an array of longs."""
    parts = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n_tokens") - 1), lambda i: _little_endian(F.substr(F.hex("ids"), (i * 8 + 1).cast("int"), F.lit(8))))
    return encoded.withColumn("ids", F.when(F.col("n_tokens") > 0, parts).otherwise(F.array().cast("array<bigint>")))


def _little_endian(digits):
    return F.conv(F.concat(*[F.substr(digits, F.lit(k), F.lit(2)) for k in (7, 5, 3, 1)]), 16, 10).cast("long")
