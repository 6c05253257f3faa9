"""A corpus pipeline over ``documents``: five stages, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir).  All but the last return the columns of
documents.  Stage settings are the operators' defaults.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seguelake.llm import decontaminate, jaccard_join, mixture, quality_rules, records
from seguelake.llm.queries import table, tokenizer_file
from seguelake.session import scratch_path


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or a risk-controlled rule rejects go."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of documents linked at a Jaccard similarity of 0.8 on five-word shingles stays."""
    return jaccard_join.keep_one(docs, n=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents appear as often as their source's weight wants, for one budget of the stage's own tokens."""
    return mixture.mix_sources(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Framed token records; the result is read back from the files."""
    target = scratch_path(spark, "records")
    records.write_records(docs, tokenizer_file(), target)
    return records.with_starts(spark.read.parquet(f"{target}/index")).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("quality rules", drop_poor),
    ("n-gram jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("source mixing", mix),
    ("token records", write_tokens),
]

# binomial thresholds, set similarity and tokenizing have no plain SQL; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            target = scratch_path(spark, f"stage-{i}")
            docs.write.parquet(target)
            docs = spark.read.parquet(target)
    return docs
