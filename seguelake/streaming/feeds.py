"""Structured Streaming jobs over event feeds.

Every job takes a streaming DataFrame and returns another; ``drain`` runs one to the
end of the available input and returns what it produced as a table.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seguelake import grouping
from seguelake.session import scratch_path

c = F.col


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
END_OF_TIME = "2200-01-01 00:00:00"  # data frames in Python workers hold times up to 2262


class Feed(NamedTuple):
    """A stream and the folder to which its end mark is written."""

    stream: DataFrame
    marks: str


def replay(spark: SparkSession, folder: str, table: str, time: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """A parquet table as a file stream; zone-less times become timestamps so that watermarks apply."""
    path = f"{folder}/{table}.parquet"
    stored = spark.read.parquet(path)
    one = stored.select(c("_metadata.file_path").alias("place")).limit(1).collect()
    source = spark.readStream.schema(stored.schema)
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    if one and one[0].place.endswith(f"/{table}.parquet"):  # a single file, and a file source wants a folder
        stream = source.option("pathGlobFilter", f"{table}.parquet").parquet(folder)
    else:
        stream = source.parquet(path)
    return stream.withColumn(time, c(time).cast("timestamp")) if time else stream


def with_end(stream: DataFrame, time: str) -> Feed:
    """The stream joined by its end marks: rows with nothing but a time far ahead of all others.

    A mark moves the watermark past every real row, so that all windows, sessions and timers
    close; it stays in the open itself, since nothing comes after it.
    """
    spark = stream.sparkSession
    marks = scratch_path(spark, "end-marks")
    spark.createDataFrame([], stream.schema).write.parquet(marks)
    return Feed(stream.unionByName(spark.readStream.schema(stream.schema).parquet(marks)), marks)


def write_end(spark: SparkSession, feed_schema: T.StructType, marks: str, time: str) -> None:
    columns = [(F.lit(END_OF_TIME) if f.name == time else F.lit(None)).cast(f.dataType).alias(f.name) for f in feed_schema.fields]
    spark.range(1).select(*columns).write.mode("append").parquet(marks)


def drain(stream: DataFrame, mode: str, keys: list[str] | None = None, end: Callable[[], None] | None = None, checkpoint: str | None = None, out: str | None = None, keyed: bool = False) -> DataFrame:
    """Process all available input; with ``keys`` the newest row per key wins over older batches.

    ``end`` writes the feed's end mark once all input is read; the job then goes on from
    its checkpoint and closes what is open.  A given ``checkpoint`` and ``out`` are continued.
    ``keyed`` jobs, which hold lists, maps and timers, keep their state in RocksDB.
    """
    spark = stream.sparkSession
    out, checkpoint = out or scratch_path(spark, "feed"), checkpoint or scratch_path(spark, "offsets")

    def save(batch: DataFrame, batch_id: int) -> None:
        # the batch id names the folder, so a repeated batch overwrites itself
        batch.withColumn("__batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/part={batch_id}")

    def run() -> None:
        query = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(save).start()
        query.awaitTermination()

    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store, None)
    if keyed:
        spark.conf.set(store, STATE_STORE)
    try:
        run()
        if end is not None:
            end()
            run()
    finally:
        if keyed:
            spark.conf.unset(store) if before is None else spark.conf.set(store, before)
    rows = spark.read.parquet(out).drop("part")
    if keys:
        rows = grouping.first_rows(rows, keys, [c("__batch").desc()])
    elif mode == "complete":
        rows = rows.join(rows.agg(F.max("__batch").alias("__batch")), "__batch")
    return rows.drop("__batch")


def latest_feedback(stream: DataFrame, keys: list[str], time: str, values: list[str]) -> DataFrame:
    """Last row per key (update mode)."""
    return stream.groupBy(*keys).agg(F.max_by(F.struct(time, *values), time).alias("last")).select(*keys, "last.*")


def comment_sessions(stream: DataFrame, by: str, time: str, gap: str, delay: str, person: str, label: str) -> DataFrame:
    """Bursts: comments no further apart than ``gap``; votes, middle time, first label and a people count."""
    d = stream.withWatermark(time, delay).groupBy(by, F.session_window(time, gap).alias("w"))
    agg = d.agg(
        F.count(F.lit(1)).alias("votes"),
        F.approx_count_distinct(person).alias("people"),
        F.percentile_approx(c(time).cast("double"), 0.5, 1000).alias("middle"),
        F.min_by(label, time).alias("label"),
    )
    return agg.select(by, c("w.start").alias("start"), c("w.end").alias("end"), "votes", "people", "middle", "label")


def window_features(stream: DataFrame, by: str, time: str, value: str, size: str, delay: str, slide: str | None = None) -> DataFrame:
    """Tumbling or sliding event statistics per key."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    d = stream.withWatermark(time, delay).groupBy(by, w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("top"))
    return d.select(by, c("w.start").alias("start"), c("w.end").alias("end"), "n", "mean", "top")


def first_copies(stream: DataFrame, content: Column, time: str, delay: str) -> DataFrame:
    """First copy per content hash within the delay."""
    return stream.withColumn("hash", content).withWatermark(time, delay).dropDuplicatesWithinWatermark(["hash"])


def valid_events(stream: DataFrame, limits: DataFrame, by: str, time: str, delay: str, slack: float = 1.02) -> DataFrame:
    """Drop events past 1.02 x the known length; ``limits`` has (by, origin seconds, duration seconds)."""
    d = stream.withWatermark(time, delay).join(limits, by, "left")
    age = c(time).cast("double") - c("origin")
    return d.filter(c("duration").isNull() | (age <= c("duration") * slack)).drop("origin", "duration")


def progress_counters(stream: DataFrame, stage: str, status: str) -> DataFrame:
    return stream.groupBy(stage, status).agg(F.count(F.lit(1)).alias("n"))


def ingest(stream: DataFrame, ledger: DataFrame, key: str, checksum: str, work: Callable[[DataFrame], DataFrame], failed: Column) -> DataFrame:
    """Only new, changed or failed inputs are worked on; returns the ledger rows of this run."""
    spark = stream.sparkSession
    out, checkpoint = scratch_path(spark, "ledger"), scratch_path(spark, "offsets")
    done = ledger.filter(c("status") == "done").select(key, checksum)

    def handle(batch: DataFrame, batch_id: int) -> None:
        todo = batch.join(done, [key, checksum], "left_anti")
        result = work(todo).withColumn("status", F.when(failed, "failed").otherwise("done"))
        result.select(key, checksum, "status").write.mode("overwrite").parquet(f"{out}/part={batch_id}")

    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(handle).start().awaitTermination()
    return spark.read.parquet(out).drop("part")
