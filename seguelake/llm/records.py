"""Token ids as length-delimited binary records with a separate offset index.

Files are written by Spark's own writer, so a lost executor only repeats its
task, and lie in ascending id order: the rows of file k come before those of
file k + 1.  A record is

    u64 length | u32 masked checksum of those 8 bytes | payload | u32 masked checksum of the payload | line feed

with little-endian numbers and payload = u8 id width | u8 1 if there is a doc_id |
i64 doc_id | ids.  Ids take two bytes where the vocabulary allows it, else four.
The mask turns a CRC-32 by 15 bits and adds a constant, so that checksums of data
that holds checksums stay useful.  The index is a table of its own: file, position
and byte range of every record, with its token count and the checksum of its ids.

Nulls and odd cases: a null text counts as empty and gives a record with the end
id alone; a null doc_id is kept, first in order; rows with equal ids follow one
another, ordered by a hash of their texts; other columns are ignored; empty tables
give no records.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seguelake.llm import words as W

MASK = 0xA282EAD8
CACHED_PIECES = 300_000
CODED_AT_ONCE = 2_000
ENCODED_BYTES = 1 << 18
ROWS_AT_ONCE = 500


def masked(crc: int) -> int:
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join([length, struct.pack("<I", masked(zlib.crc32(length))), payload, struct.pack("<I", masked(zlib.crc32(payload)))])


def frames(content: memoryview) -> Iterator[tuple[int, int, memoryview]]:
    """(offset, bytes, payload) of each record; raises on a broken one."""
    at = 0
    while at < len(content):
        length, check = struct.unpack_from("<QI", content, at)
        end = at + 12 + length
        if masked(zlib.crc32(content[at : at + 8])) != check or end + 5 > len(content):
            raise ValueError(f"broken record length at byte {at}")
        payload = content[at + 12 : end]
        if masked(zlib.crc32(payload)) != struct.unpack_from("<I", content, end)[0] or content[end + 4] != 10:
            raise ValueError(f"broken record at byte {at}")
        yield at, end + 5 - at, payload
        at = end + 5


def pack(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    return struct.pack("<BBq", width, doc_id is not None, doc_id or 0) + ids.astype(f"<u{width}").tobytes()


def unpack(payload: memoryview) -> tuple[int | None, np.ndarray]:
    width, known, doc_id = struct.unpack_from("<BBq", payload)
    return (doc_id if known else None), np.frombuffer(payload, f"<u{width}", offset=10)


class PieceEncoder:
    """Encodes blocks of texts through a cache of the pieces they are made of.

    The tokenizer never joins text across white space, nor across a border
    between an ASCII letter and one of the marks below, so pieces are encoded once.
    """

    MARKS = b".,!?;:*#$%&()[]{}/+=-\""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already uses all cores; threads would each hold memory
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.prints = W.Fingerprints()
        self.kind = np.full(256, 3, np.uint8)
        self.kind[W.WHITE] = 0
        self.kind[0x41:0x5B] = self.kind[0x61:0x7B] = 1
        self.kind[list(self.MARKS)] = 2
        self._clear()

    def _clear(self) -> None:
        self.keys, self.at, self.size, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, start: np.ndarray, end: np.ndarray, data: np.ndarray) -> None:
        if len(self.keys) + len(keys) > CACHED_PIECES:
            self._clear()
        raw = data.tobytes()
        found: list[list[int]] = [[]] * len(keys)
        rest = []
        tokenize = self.tokenizer.model.tokenize
        for i, (a, b) in enumerate(zip(start.tolist(), end.tolist())):
            piece = raw[a:b]
            if piece.isalpha() and piece.islower():  # ASCII letters: no normalising or splitting to do
                found[i] = [t.id for t in tokenize(piece.decode())]
            else:
                rest.append(i)
        for at in range(0, len(rest), CODED_AT_ONCE):  # encodings take far more room than their ids
            some = rest[at : at + CODED_AT_ONCE]
            for i, e in zip(some, self.tokenizer.encode_batch_fast([raw[start[i] : end[i]].decode() for i in some], add_special_tokens=False)):
                found[i] = e.ids
        size = np.fromiter(map(len, found), np.int64, len(found))
        at = len(self.flat) + np.cumsum(size) - size
        self.flat = np.concatenate([self.flat, np.fromiter((x for f in found for x in f), np.uint32, int(size.sum()))])
        slot = np.searchsorted(self.keys, keys)  # both are sorted
        self.keys, self.at, self.size = np.insert(self.keys, slot, keys), np.insert(self.at, slot, at), np.insert(self.size, slot, size)

    def _known(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), bool)
        return self.keys[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)] == keys

    def block(self, block: W.Block) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block and the number of ids of each text."""
        data = block.data
        if b"<|" not in data.tobytes():  # special tokens are case-sensitive; nothing else is
            data = W.LOWER[data]
        kind = self.kind[data]
        n = len(kind)
        head = np.zeros(n + 1, bool)
        if n:
            # a border lies before byte i, or after the last one
            head[1:n] = (kind[1:] != kind[:-1]) & ((kind[1:] == 0) | (kind[:-1] == 0) | (kind[1:] + kind[:-1] == 3) & (kind[1:] * kind[:-1] == 2))
            head[block.starts[block.starts < n]] = True
            head[n] = True
        edge = np.flatnonzero(head)
        start, end = edge[:-1], edge[1:]
        solid = kind[start] != 0
        start, end = start[solid], end[solid]
        text = np.searchsorted(block.starts, start, "right") - 1
        keys = self.prints.spans(self.prints.prefix(data), start, end)
        unique, first, which = np.unique(keys, return_index=True, return_inverse=True)
        new = ~self._known(unique)
        if new.any():
            if len(self.keys) + int(new.sum()) > CACHED_PIECES:
                self._clear()
                new[:] = True
            self._learn(unique[new], start[first[new]], end[first[new]], data)
        slot = np.searchsorted(self.keys, unique)[which]
        size, at = self.size[slot], self.at[slot]
        before = np.cumsum(size) - size
        total = int(size.sum())
        ids = self.flat[np.repeat(at - before, size) + np.arange(total)] if total else np.zeros(0, np.uint32)
        return ids, block.per_text(text, size).astype(np.int64)


@lru_cache(maxsize=1)
def encoder(path: str) -> PieceEncoder:
    """One encoder per Python worker: its tasks share the loaded tokenizer and the pieces seen."""
    return PieceEncoder(path)


def write_records(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 1) -> None:
    """Encode ``text``, append ``end_id`` and write records in ascending ``doc_id`` order, then the index.

    One shuffle by ranges of the id; AQE and the session's shuffle partitions set the file size.
    """
    spark = docs.sparkSession
    tie = F.xxhash64("text")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        width = 2 if max(coder.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1) <= 1 << 16 else 4
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(first, ROWS_AT_ONCE)
                names = batch.column(0).to_pylist()
                for block in W.blocks(batch.column(1), ENCODED_BYTES):
                    ids, sizes = coder.block(block)
                    cut = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
                    out = [frame(pack(names[block.first + i], np.append(ids[cut[i] : cut[i + 1]], np.uint32(end_id)), width)) for i in range(block.n)]
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    # the text writer adds the record's last byte, the line feed
    rows.mapInArrow(encode, "value binary").select(F.col("value").cast("string").alias("value")).write.text(f"{folder}/data")
    index_records(spark, folder).write.parquet(f"{folder}/index")


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/data").select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "content"
    )


def index_records(spark: SparkSession, folder: str) -> DataFrame:
    """Read all files, verify every checksum and give one index row per record."""
    schema = "file string, file_no int, position long, offset long, bytes long, doc_id long, n_tokens long, ids_crc32 long"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1)):
                file = file.as_py()
                found = []
                for position, (offset, size, payload) in enumerate(frames(memoryview(content.as_buffer()))):
                    doc_id, ids = unpack(payload)
                    found.append((position, offset, size, doc_id, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                cols = list(zip(*found)) if found else [[]] * 6
                number = int(file.split("-")[1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file] * len(found), pa.string()), pa.array([number] * len(found), pa.int32()), *[pa.array(c, pa.int64()) for c in cols]],
                    names=["file", "file_no", "position", "offset", "bytes", "doc_id", "n_tokens", "ids_crc32"],
                )

    return _files(spark, folder).mapInArrow(scan, schema)


def with_starts(index: DataFrame) -> DataFrame:
    """Add ``start``, the number of ids before each record: inside its file, plus the sizes of all earlier files (one small row each)."""
    inside = Window.partitionBy("file_no").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    sizes = index.groupBy("file_no").agg(F.sum("n_tokens").alias("__all"))
    earlier = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(F.col("file_no").alias("__no"), F.coalesce(F.sum("__all").over(earlier), F.lit(0)).alias("__base"))
    placed = index.withColumn("start", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return placed.join(bases, placed["file_no"] == bases["__no"]).withColumn("start", F.col("start") + F.col("__base")).drop("__no", "__base")


def read_records(spark: SparkSession, folder: str, chosen: DataFrame | None = None) -> DataFrame:
    """(doc_id, ids) of the records that ``chosen`` rows of the index name; of all records by default."""
    index = chosen if chosen is not None else spark.read.parquet(f"{folder}/index")
    wanted = index.groupBy(F.col("file").alias("__file")).agg(F.collect_list("offset").alias("offsets"))  # at most a file's records
    files = _files(spark, folder)
    rows = files.join(wanted, files["file"] == wanted["__file"]).select("content", "offsets")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, offsets in zip(batch.column(0), batch.column(1)):
                view = memoryview(content.as_buffer())
                found = []
                for at in offsets.as_py():
                    length = struct.unpack_from("<Q", view, at)[0]
                    found.append(unpack(next(frames(view[at : at + length + 17]))[2]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d for d, _ in found], pa.int64()), pa.array([i.astype(np.int32) for _, i in found], pa.list_(pa.int32()))], names=["doc_id", "ids"]
                )

    return rows.mapInArrow(take, "doc_id long, ids array<int>")


def read_shuffled(spark: SparkSession, folder: str, seed: int) -> DataFrame:
    """All records in an order fixed by ``seed``; ``order`` is the sort key."""
    rows = read_records(spark, folder).withColumn("order", F.xxhash64("doc_id", "ids", F.lit(seed)))
    return rows.repartitionByRange("order").sortWithinPartitions("order")
