"""Words, lines and n-grams of Arrow text columns as numpy arrays.

Text is handled as UTF-8 bytes in blocks of a megabyte, so that no step
runs per word in Python and memory does not depend on the partition's size.
Words are identified by 64-bit fingerprints: two different words meet with a
chance of about n^2 / 2^65 for n distinct words.

Null texts count as empty ones.  Text is never cut: a text longer than a block
makes a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NOT_WHITE = ~WHITE
LETTERS = np.zeros(256, bool)
LETTERS[0x41:0x5B] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
STEP = 0x5851F42D4C957F2D
ODD = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 bits; one-to-one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Fingerprints:
    """64-bit fingerprints of byte spans from prefix sums of a polynomial."""

    def __init__(self):
        self.code = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(ODD))
        self.power = np.ones(1, np.uint64)
        self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) >= n:
            return
        n = max(n, BLOCK_BYTES + 1)
        back = pow(STEP, -1, 1 << 64)
        self.power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, STEP, np.uint64)]))
        self.inverse = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, back, np.uint64)]))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.code[data] * self.power[: len(data)], out=sums[1:])
        return sums

    def spans(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        inner = (sums[end] - sums[start]) * self.inverse[start]
        return mix(inner ^ (end - start).astype(np.uint64) * np.uint64(ODD))


class Block:
    """Consecutive texts: rows ``first`` to ``last`` of a batch, their bytes, and where each starts and ends."""

    def __init__(self, first: int, offsets: np.ndarray, data: np.ndarray):
        self.first, self.n = first, len(offsets) - 1
        self.starts, self.ends = offsets[:-1], offsets[1:]
        self.data = data

    def words(self, member: np.ndarray = NOT_WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, text) of each maximal run of member bytes, in order."""
        inside = member[self.data]
        n = len(inside)
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], after[-1] = False, False
            before[1:], after[:-1] = inside[:-1], inside[1:]
            before[self.starts[self.starts < n]] = False
            after[self.ends[self.ends > 0] - 1] = False
        start = np.flatnonzero(inside & ~before)
        end = np.flatnonzero(inside & ~after) + 1
        return start, end, np.searchsorted(self.starts, start, "right") - 1

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, text) of each line between line feeds."""
        breaks = np.flatnonzero(self.data == 10)
        start = np.concatenate([self.starts, breaks + 1])
        text = np.concatenate([np.arange(self.n), np.searchsorted(self.starts, breaks, "right") - 1])
        end = np.concatenate([breaks, self.ends])
        order = np.lexsort((start, text))
        ends = np.concatenate([np.searchsorted(self.starts, breaks, "right") - 1, np.arange(self.n)])
        return start[order], end[np.lexsort((end, ends))], text[order]

    def total(self, values: np.ndarray) -> np.ndarray:
        """Sum of a per-byte array over each text."""
        sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])
        return sums[self.ends] - sums[self.starts]

    def per_text(self, text: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        out = np.bincount(text, weights, minlength=self.n)
        return out if weights is not None else out.astype(np.int64)


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a text column into blocks of whole texts of about ``size`` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, raw, payload = column.buffers()
    offsets = np.frombuffer(raw, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(payload, np.uint8) if payload is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        cut = offsets[first : last + 1]
        yield Block(first, cut - cut[0], data[cut[0] : cut[-1]])
        first = last


def grams(words: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all runs of ``n`` words inside one text, and the index of their first word."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = words[:count].copy()
    for k in range(1, n):
        out *= np.uint64(STEP)
        out += words[k : k + count]
    at = np.flatnonzero(text[:count] == text[n - 1 :])
    return mix(out[at]), at


def crc_remainder(column: str, n: int) -> str:
    """SQL for crc32 of an id written as text, modulo ``n``; null ids count as the empty text."""
    return f"crc32(cast(coalesce(cast({column} AS string), '') AS binary)) % {n}"
