"""The backlog of queued batch files: listing, statistics and the byte cap."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallylog.functions.times import ntz
from tallylog.operators.scan import ORDERED_BLOCK, ordered_blocks, running


def list_backlog(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """(path, size, modified) of the queued files; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select(
        "path", F.col("length").alias("size"),
        F.col("modificationTime").cast("timestamp_ntz").alias("modified"),
    )


def backlog_stats(backlog: DataFrame, now: str) -> DataFrame:
    """One row: file_count, total_bytes and the age of the oldest file, never negative."""
    age = F.timestamp_diff("SECOND", F.col("modified"), ntz(now))
    return backlog.agg(
        F.count(F.lit(1)).alias("file_count"),
        F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("total_bytes"),
        F.coalesce(F.max(F.greatest(age, F.lit(0))), F.lit(0)).alias("oldest_age_seconds"),
    )


def backlog_over_cap(backlog: DataFrame, max_bytes: int) -> DataFrame:
    """Paths to drop, oldest first in path order, until the rest fits ``max_bytes``.

    A file goes when the bytes before it are fewer than the excess. Without a cap
    (``max_bytes`` <= 0) nothing goes. The order key is text, so the rows are range-partitioned
    once and that placement is checkpointed before the two-pass running size.
    """
    if max_bytes <= 0:
        return backlog.select("path", "size").limit(0)
    placed = ordered_blocks(backlog.select("path", "size"), ["path"])
    total = placed.agg(F.coalesce(F.sum("size"), F.lit(0))).scalar()
    sized = running(
        placed, "order_no", sums={"_older": F.col("size")}, before=True, block=ORDERED_BLOCK
    )
    return sized.where(F.col("_older") < total - F.lit(max_bytes)).select("path", "size")


def replay_order(backlog: DataFrame) -> DataFrame:
    """Oldest first."""
    return backlog.orderBy("path")
