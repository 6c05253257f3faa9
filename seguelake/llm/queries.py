"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seguelake.llm import byte_bpe, decontaminate, hard_negatives, jaccard_join, license_scan, lz_dedup, merkle, mixture, pitman_yor, quality_model, quality_rules, records, statements, toxicity
from seguelake.llm.words import crc_remainder
from seguelake.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {"op11_merkle_manifest": statements.MERKLE, "op12_hard_negatives": statements.HARD_NEGATIVES}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Every benchmark item found in a document, also with its numbers, names or units replaced."""
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("text_hash")


@query
def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity score of every document with its nearest labelled examples, learned from four fifths of the labelled ids."""
    scored = toxicity.score(table(spark, folder, "documents"), table(spark, folder, "labels"), lambda c: F.expr(f"{crc_remainder(c, 5)} <> 0"))
    return scored.select("doc_id", F.expr(f"{crc_remainder('doc_id', 5)} = 0").alias("held_out"), "score", "predicted", "evidence")


@query
def op3_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose four-word shingles have a Jaccard similarity of at least 0.85."""
    return jaccard_join.link_documents(table(spark, folder, "documents"), n=4, percent=85)


@query
def op4_token_records(spark: SparkSession, folder: str) -> DataFrame:
    """Write all documents as framed records and report them from the files."""
    target = scratch_path(spark, "records")
    records.write_records(table(spark, folder, "documents"), tokenizer_file(), target)
    return records.with_starts(spark.read.parquet(f"{target}/index")).select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op5_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document, learned from two thirds of the labelled ids."""
    scored = quality_model.score(table(spark, folder, "documents"), table(spark, folder, "labels"), lambda c: F.expr(f"{crc_remainder(c, 3)} <> 1"))
    return scored.select("doc_id", F.expr(f"{crc_remainder('doc_id', 3)} = 1").alias("held_out"), "score", "predicted")


@query
def op6_pitman_yor_lm(spark: SparkSession, folder: str) -> DataFrame:
    """Log10 probabilities of every document under a hierarchical Pitman-Yor model of four fifths of them."""

    def remainder(doc_id: int | None) -> int:
        return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5

    scored = pitman_yor.score(table(spark, folder, "documents"), lambda i: remainder(i) != 1)
    return scored.select("doc_id", F.expr(f"{crc_remainder('doc_id', 5)} = 1").alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Counts, base rule and risk-controlled verdict of every document."""
    judged = quality_rules.assess(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("rejected_by", ",").alias("rejected_by"))


@query
def op8_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """The documents chosen for one corpus-sized budget in which no source is repeated over 1.25 times."""
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    mixed = mixture.realise(docs.drop("text"), mixture.plan(docs))
    return mixed.select("doc_id", "source", "epoch", "block", "block_key", "doc_key")


@query
def op9_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the words of 13-word windows that a smaller id also starts."""
    return lz_dedup.deduplicate(table(spark, folder, "documents"))


@query
def op10_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """License phrases and notices of every document."""
    return license_scan.scan(table(spark, folder, "documents"))


@query
def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Root, inclusion proof and verification of every document; every seventh is checked with a changed n_chars."""
    docs = table(spark, folder, "documents")
    fields = lambda n_chars: [F.col(c) for c in ("doc_id", "source", "lang")] + [n_chars, F.col("text")]
    changed = F.expr(f"{crc_remainder('doc_id', 7)} = 0")
    rows = docs.select("doc_id", "lang", merkle.leaf(fields(F.col("n_chars"))).alias("leaf"), F.when(changed, merkle.leaf(fields(F.col("n_chars") + 1))).alias("claimed"))
    proofs = merkle.prove(merkle.build(rows, "lang", "doc_id", "leaf", carry=("doc_id", "claimed")))
    folded = proofs.withColumn("folded_root", merkle.fold(F.coalesce("claimed", "leaf"), F.col("proof")))
    return folded.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


@query
def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every hundredth vector among all vectors; every seventh label is moved on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0)


@query
def op13_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document and the text decoded from them."""
    name = tokenizer_file("byte_bpe_50k.json")
    decoded = byte_bpe.decode(byte_bpe.encode(table(spark, folder, "documents"), name), name)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
