"""Table functions: Python that reads a partition row by row and emits rows, for use in SQL and DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf


class PickWindows:
    """Rows of one partition, best score first: the first ``k`` whose peaks lie ``separation`` apart.

    ``peak``, ``score``, ``first`` and ``last`` (the span of the whole partition) are read from each
    row; only the picks so far are kept, so partitions may be of any length.
    """

    def __init__(self) -> None:
        self.picks: list[float] = []

    def eval(self, row: Row, k: int, separation: float, half: float) -> Iterator[tuple]:
        peak = row["peak"]
        if peak is None or row["score"] is None or len(self.picks) >= k or any(abs(peak - other) < separation for other in self.picks):
            return
        self.picks.append(peak)
        yield len(self.picks), peak, row["score"], max(row["first"], peak - half), min(row["last"], peak + half)


pick_windows = udtf(PickWindows, returnType="rank int, peak double, score double, start double, end double", useArrow=True)


def register(spark: SparkSession) -> None:
    """Make the functions known to SQL: ``pick_windows(TABLE(t) PARTITION BY g ORDER BY (score DESC, peak), k, separation, half)``."""
    spark.udtf.register("pick_windows", pick_windows)


def windows_by_function(peaks: DataFrame, span: DataFrame, by: str, t: str, score: str, k: int, separation: float, half: float) -> DataFrame:
    """What ``spaced_peaks`` gives, by one sorted pass per group instead of a join per pick."""
    ends = span.groupBy(F.col(by).alias("__by")).agg(F.min(t).alias("first"), F.max(t).alias("last"))
    rows = peaks.join(ends, F.col(by) == F.col("__by")).select(by, F.col(t).cast("double").alias("peak"), F.col(score).cast("double").alias("score"), F.col("first").cast("double").alias("first"), F.col("last").cast("double").alias("last"))
    # a table function returns its own columns only, so this one also returns the group's key
    keyed = udtf(_with_key(PickWindows, by), returnType=f"{by} {rows.schema[by].dataType.simpleString()}, rank int, peak double, score double, start double, end double", useArrow=True)
    return keyed(rows.asTable().partitionBy(by).orderBy(F.col("score").desc(), F.col("peak")), F.lit(k), F.lit(separation), F.lit(half))


def _with_key(base: type, by: str) -> type:
    class Keyed(base):
        def eval(self, row: Row, k: int, separation: float, half: float) -> Iterator[tuple]:
            for out in base.eval(self, row, k, separation, half):
                yield (row[by], *out)

    return Keyed
