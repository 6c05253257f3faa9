"""How the given tables stand in for tracks, mixes, frames and the rest."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seguelake import grouping
from seguelake.functions import harmony

SLOT_ORDER = ["line", "track", "venue", "price"]
EPOCH = "timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', {0})"


class Tables:
    """Lazily read parquet tables and their domain views."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def plays(self) -> DataFrame:
        """Line items as plays of a track in a mix, without positions."""
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("mix"),
            F.col("l_partkey").alias("track"),
            F.col("l_suppkey").alias("venue"),
            F.col("l_linenumber").alias("line"),
            F.col("l_extendedprice").alias("price"),
            F.col("l_quantity").alias("qty"),
            F.col("l_discount").alias("discount"),
            F.col("l_tax").alias("tax"),
            F.col("l_returnflag").alias("flag"),
            F.col("l_linestatus").alias("status"),
            F.col("l_shipdate").alias("shipped"),
        )

    def slots(self, *extra: str) -> DataFrame:
        """(mix, position, track) plus ``extra`` columns of ``plays``."""
        wanted = list(dict.fromkeys(["mix", *SLOT_ORDER, *extra]))
        placed = grouping.position(
            self.plays.select(*wanted), ["mix"], SLOT_ORDER, [F.col("line"), F.floor(F.col("track") / 4096)]
        )
        return placed.select("mix", "position", "track", *extra)

    @property
    def slot_bins(self) -> list:
        return [F.floor(F.col("position") / 4096)]

    @cached_property
    def tracks(self) -> DataFrame:
        key = F.col("p_partkey")
        coded = self.raw("part").select(
            key.alias("track"),
            (F.col("p_size") + 90).cast("double").alias("bpm"),
            F.concat((key % 12 + 1).cast("string"), F.when(F.floor(key / 12) % 2 == 0, "A").otherwise("B")).alias("camelot"),
            (key % 10 / 10.0).alias("key_conf"),
            F.round(F.col("p_retailprice") % 100 / 100.0, 6).alias("energy"),
            F.round(key * 7 % 97 / 96.0, 6).alias("bass"),
            F.round(key * 13 % 89 / 88.0, 6).alias("vocal"),
            F.col("p_brand").alias("style"),
            F.col("p_type").alias("release"),
            F.col("p_name").alias("title"),
        )
        return coded.withColumn("key", harmony.key_index(F.col("camelot")))

    @cached_property
    def mixes(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_orderkey").alias("mix"),
            F.col("o_custkey").alias("dj"),
            F.to_date("o_orderdate").alias("day"),
            F.col("o_totalprice").alias("fee"),
            F.col("o_orderpriority").alias("priority"),
            F.col("o_orderstatus").alias("state"),
        )

    @cached_property
    def frames(self) -> DataFrame:
        """Events as per-track frames; ``us`` is whole microseconds."""
        return self.raw("events").select(
            "event_id",
            F.col("user_id").alias("track"),
            F.expr(EPOCH.format("ts")).alias("us"),
            (F.expr(EPOCH.format("ts")) / 1e6).alias("t"),
            "value",
            F.get_json_object("props", "$.k").cast("int").alias("k"),
            F.col("event_type").alias("label"),
        )

    @property
    def frame_bins(self) -> list:
        return [F.floor(F.col("us") / 3_600_000_000)]

    @cached_property
    def vectors(self) -> DataFrame:
        return self.raw("embeddings").select(
            F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), F.col("label").alias("grp")
        )

    def vector_of(self, track: str) -> Column:
        """Id of the vector that stands for a track; there are fewer vectors than tracks, with ids from 0."""
        return F.col(track) % self.raw("embeddings").agg(F.count(F.lit(1))).scalar()

    @cached_property
    def documents(self) -> DataFrame:
        return self.raw("documents")


# The same views as SQL text, for the oracle statements.
SLOTS = """slots AS (SELECT l_orderkey AS mix, l_partkey AS track, l_suppkey AS venue, l_extendedprice AS price,
 l_quantity AS qty, l_discount AS discount, l_returnflag AS flag, l_linestatus AS status, l_shipdate AS shipped,
 row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS position FROM lineitem)"""
TRACKS = """tracks AS (SELECT p_partkey AS track, CAST(p_size + 90 AS DOUBLE) AS bpm,
 CAST(p_partkey % 12 + 1 AS VARCHAR) || CASE WHEN (p_partkey // 12) % 2 = 0 THEN 'A' ELSE 'B' END AS camelot,
 CAST(p_partkey % 12 + 1 AS INTEGER) AS num, CASE WHEN (p_partkey // 12) % 2 = 0 THEN 'A' ELSE 'B' END AS mode,
 p_partkey % 10 / 10.0::DOUBLE AS key_conf, round(p_retailprice % 100 / 100.0::DOUBLE, 6) AS energy,
 round((p_partkey * 7 % 97) / 96.0::DOUBLE, 6) AS bass, round((p_partkey * 13 % 89) / 88.0::DOUBLE, 6) AS vocal,
 p_brand AS style, p_type AS release, p_name AS title FROM part)"""
MIXES = """mixes AS (SELECT o_orderkey AS mix, o_custkey AS dj, CAST(o_orderdate AS DATE) AS day, o_totalprice AS fee,
 o_orderpriority AS priority, o_orderstatus AS state FROM orders)"""
FRAMES = """frames AS (SELECT event_id, user_id AS track, date_diff('microsecond', TIMESTAMP '2024-01-01', ts) AS us,
 date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 1e6 AS t, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
 event_type AS label FROM events)"""
PAIRS = """pairs AS (SELECT * FROM (SELECT mix, position, track AS a, lead(track) OVER (PARTITION BY mix ORDER BY position) AS b
 FROM slots) WHERE b IS NOT NULL AND a <> b)"""


def sql_fold(a: str, b: str) -> str:
    """Smallest relative gap over the multiples of b."""
    return f"(least(abs({a}-{b}), abs({a}-2*{b}), abs({a}-0.5*{b}))/{a})"


def sql_step(a: str, b: str) -> str:
    x = f"{sql_fold(a, b)}*100.0"
    return (
        f"(CASE WHEN {x} < 2 THEN '0-2%' WHEN {x} < 4 THEN '2-4%' WHEN {x} < 6 THEN '4-6%' "
        f"WHEN {x} < 10 THEN '6-10%' ELSE '>10%' END)"
    )


def sql_relation(na: str, ma: str, nb: str, mb: str) -> str:
    d = f"least(abs({na}-{nb}), 12-abs({na}-{nb}))"
    return (
        f"(CASE WHEN {d} = 0 AND {ma} = {mb} THEN 'exact' WHEN {d} = 0 THEN 'relative_major_minor' "
        f"WHEN {d} = 1 AND {ma} = {mb} THEN 'adjacent_same_mode' WHEN {d} = 2 AND {ma} = {mb} THEN 'cautious' ELSE 'risky' END)"
    )


def sql_whole_word(text: str, word: str) -> str:
    """RE2 knows word boundaries of ASCII only, so the neighbours are spelled out."""
    return rf"regexp_matches({text}, '(?i)(^|[^\p{{L}}\p{{N}}_]){word}([^\p{{L}}\p{{N}}_]|$)')"
