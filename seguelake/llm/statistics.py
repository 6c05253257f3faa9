"""Surface statistics of documents, shared by the quality operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seguelake.llm import words as W

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_stops",
    "n_distinct", "n_echo", "n_long", "n_chars", "n_accent",
)


def count_block(block: W.Block, prints: W.Fingerprints) -> dict[str, np.ndarray]:
    """The counts of every text of a block."""
    data, n = block.data, block.n
    start, end, text = block.words()
    lead = (data & 0xC0) != 0x80
    sums = prints.prefix(data)
    ids = prints.spans(sums, start, end)
    own = W.mix((np.arange(n, dtype=np.uint64) + np.uint64(1)) * np.uint64(W.ODD))
    out = {"n_words": block.per_text(text), "n_chars": block.total(lead), "word_chars": block.total(lead & W.NOT_WHITE[data])}
    for name, bytes_ in (("n_symbols", b"#*$%&|<>"), ("n_marks", b"!?"), ("n_stops", b".,;:"), ("n_digits", b"0123456789")):
        chosen = np.zeros(256, bool)
        chosen[list(bytes_)] = True
        out[name] = block.total(chosen[data])
    out["n_upper"] = block.total((data >= 0x41) & (data <= 0x5A))
    out["n_accent"] = block.total(data >= 0xC0)
    line_start, line_end, line_text = block.lines()
    filled = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    line = prints.spans(sums, line_start[filled], line_end[filled]) + own[line_text[filled]]
    _, first = np.unique(line, return_index=True)
    out["n_lines"] = block.per_text(line_text[filled])
    out["n_dup_lines"] = out["n_lines"] - block.per_text(line_text[filled][first])
    gram, at = W.grams(ids, text, 3)
    _, which, times = np.unique(gram + own[text[at]], return_inverse=True, return_counts=True)
    covered = np.zeros(len(ids) + 1, np.int64)
    again = at[times[which] > 1]
    np.add.at(covered, again, 1)
    np.add.at(covered, again + 3, -1)
    out["n_repeat_words"] = block.per_text(text[np.cumsum(covered)[:-1] > 0])
    _, first = np.unique(ids + own[text], return_index=True)
    out["n_distinct"] = block.per_text(text[first])
    echo = np.flatnonzero((ids[1:] == ids[:-1]) & (text[1:] == text[:-1])) if len(ids) else np.zeros(0, np.int64)
    out["n_echo"] = block.per_text(text[echo])
    out["n_long"] = block.per_text(text[end - start > 20])
    return out


def document_counts(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row of counts per document next to its ``keep`` columns.

    Null and empty texts give zeros; repeated rows and ids give repeated rows; other columns are ignored.
    """
    source = docs.select(*[docs[k] for k in keep], docs[text].alias("__text"))
    kept = [f for f in source.schema.fields if f.name != "__text"]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], *[f"{c} bigint" for c in COUNTS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = W.Fingerprints()
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            parts = [count_block(b, prints) for b in W.blocks(column)]
            if parts:
                cols = [pa.array(np.concatenate([p[c] for p in parts]), pa.int64()) for c in COUNTS]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *cols], names=[*[f.name for f in kept], *COUNTS])

    return source.mapInArrow(run, schema)


def labelled(counts: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """Counts joined with labels of 0 or 1; each labelled id counts once per document row and label row."""
    marks = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("__id"), F.col(label).alias("__label"))
    return counts.join(marks, counts["doc_id"] == marks["__id"]).drop("__id")
