"""Change logs: applying ordered write-sets to a snapshot, and compaction.

Snapshots are versions of a committed-batch table: a version is a batch and the head of its commit
is the generation it reaches, so readers move from one version to the next in one step.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallylog.operators.scan import broken_links
from tallylog.session import released_checkpoints
from tallylog.sources.tables import BatchTable

#: Generations that may be left for the last round, rounds before it, and seconds for all of them.
MAX_LAG, MAX_ROUNDS, MAX_SECONDS = 32, 8, 30.0

# The kinds of change and the tables they may touch.
KINDS = ("put", "delete", "create", "sequence")
TABLES = (
    "meta", "events", "ids", "receipt_times", "receipt_ids", "catalog", "archive_cache",
    "operations", "captures",
)


def read_change_log(spark: SparkSession, path: str, after: int = 0) -> DataFrame:
    """Write-sets (generation, writes array) as one row per write, with its position ``idx``."""
    schema = (
        "generation bigint, writes array<struct<bucket string, key string, kind string, "
        "value string, sequence bigint>>"
    )
    sets = spark.read.schema(schema).parquet(path).where(F.col("generation") > after)
    return explode_writes(sets)


def explode_writes(sets: DataFrame) -> DataFrame:
    return sets.select("generation", F.posexplode("writes").alias("idx", "w")).select(
        "generation", "idx", "w.*"
    )


def apply_change_log(base: DataFrame, log: DataFrame) -> DataFrame:
    """The snapshot (bucket, key, value) after the log; the last write of a key wins.

    One pre-aggregated row per key is kept, so a key written a billion times costs one row per
    task. ``sequence`` writes set the counter of their table and appear under the key
    ``#sequence``; ``create`` makes an empty table and leaves no row.
    """
    writes = log.where(F.col("kind").isin("put", "delete", "sequence")).select(
        "bucket",
        F.when(F.col("kind") == "sequence", "#sequence").otherwise(F.col("key")).alias("key"),
        F.struct("generation", "idx").alias("at"),
        F.when(F.col("kind") == "sequence", F.col("sequence").cast("string"))
        .when(F.col("kind") == "put", F.col("value"))
        .alias("value"),
        (F.col("kind") != "delete").alias("kept"),
    )
    last = writes.groupBy("bucket", "key").agg(
        F.max_by(F.struct("value", "kept"), "at").alias("w")
    )
    untouched = base.select("bucket", "key", "value").join(last, ["bucket", "key"], "left_anti")
    return untouched.unionByName(
        last.where("w.kept").select("bucket", "key", F.col("w.value").alias("value"))
    )


def change_log_violations(log: DataFrame, generation: int | None = None) -> DataFrame:
    """(rule, detail): gaps in the generations, unknown kinds or tables, entries past the end."""
    bad = log.where(
        ~F.coalesce(F.col("kind").isin(*KINDS) & F.col("bucket").isin(*TABLES), F.lit(False))
    ).select(
        F.lit("change_kind").alias("rule"), F.concat_ws("/", "generation", "idx").alias("detail")
    )
    generations = log.select("generation").distinct()
    start = generations.agg(F.min("generation").alias("s"))
    linked = generations.select("generation", F.col("generation").alias("last"))
    gaps = broken_links(linked, [], "generation", "last", first=1)
    # The log may start at any generation; only its first entry is allowed to.
    gaps = gaps.join(start, F.col("generation") == F.col("s"), "left_anti").select(
        F.lit("generation_gap").alias("rule"), F.col("generation").cast("string").alias("detail")
    )
    out = bad.unionByName(gaps)
    if generation is not None:
        late = generations.where(
            (F.col("generation") > generation) | (F.col("generation") < 1)
        ).select(
            F.lit("generation_bound").alias("rule"),
            F.col("generation").cast("string").alias("detail"),
        )
        out = out.unionByName(late)
    return out


def compact_table(base: DataFrame, log: DataFrame, path: str, order: str = "key") -> None:
    """Rewrite the snapshot with the log applied into a new place, range-sorted.

    A broken log stops the rewrite; the old copy stays valid until its readers are moved.
    """
    broken = change_log_violations(log)
    if not broken.isEmpty():
        raise ValueError("the change log is not gap-free or has unknown writes")
    (
        apply_change_log(base, log)
        .repartitionByRange("bucket", order)
        .sortWithinPartitions("bucket", order)
        .write.mode("overwrite")
        .parquet(path)
    )


class CompactionError(RuntimeError):
    """The compaction was given up; readers keep the version they have."""


def snapshot_table(spark: SparkSession, path: str) -> BatchTable:
    return BatchTable(spark, path, "bucket string, key string, value string")


def publish_snapshot(table: BatchTable, rows: DataFrame, generation: int) -> int:
    """Write rows as the next version, visible at once; its number."""
    last = table.commits().agg(F.max("batch_id")).first()[0]
    version = 0 if last is None else last + 1
    table.write(_sorted(rows), version)
    table.commit(version, generation)
    return version


def current_snapshot(table: BatchTable) -> tuple[DataFrame, int]:
    """The newest version and the generation that it reaches."""
    newest = table.commits().agg(F.max_by(F.struct("batch_id", "head"), "batch_id")).first()[0]
    if newest is None:
        raise CompactionError("there is no snapshot yet")
    rows = table.read().where(F.col("batch_id") == newest["batch_id"])
    return rows.select("bucket", "key", "value"), newest["head"]


def _sorted(rows: DataFrame) -> DataFrame:
    return (
        rows.select("bucket", "key", "value").repartitionByRange("bucket", "key")
        .sortWithinPartitions("bucket", "key")
    )


def snapshot_violations(rows: DataFrame) -> DataFrame:
    """(rule, detail): keys that are there twice, rows without a value, unknown tables."""
    counts = rows.groupBy("bucket", "key").agg(F.count(F.lit(1)).alias("n"))
    name = F.concat_ws("/", "bucket", "key").alias("detail")
    twice = counts.where("n > 1").select(F.lit("key_repeated").alias("rule"), name)
    empty = rows.where(F.col("value").isNull() | F.col("key").isNull()).select(
        F.lit("value_missing").alias("rule"), name)
    unknown = rows.where(~F.coalesce(F.col("bucket").isin(*TABLES), F.lit(False))).select(
        F.lit("unknown_table").alias("rule"), name)
    return twice.unionByName(empty).unionByName(unknown)


def compact_online(
    table: BatchTable,
    read_log: Callable[[int], DataFrame],
    between: Callable[[int], None] = lambda number: None,
    audit: Callable[[DataFrame], DataFrame] = snapshot_violations,
    max_lag: int = MAX_LAG,
    max_rounds: int = MAX_ROUNDS,
    max_seconds: float = MAX_SECONDS,
) -> int:
    """Rewrite the current snapshot with its log while the log goes on growing; the new generation.

    ``read_log(after)`` gives the writes of later generations. The first rewrite takes what is there;
    each round then applies what arrived during the one before, which is less and less unless
    writers outrun the rounds. When at most ``max_lag`` generations are left they are applied as the
    last round, the result is audited, and one commit makes it the version that readers see. The
    log's writers must pause for that last round. More rounds than ``max_rounds``, a longer catch-up
    than ``max_seconds``, a gap in the log or a finding of the audit raise ``CompactionError``.
    ``between`` is called after each rewrite, with its number.
    """
    rows, reached = current_snapshot(table)
    last = table.commits().agg(F.max("batch_id")).first()[0]
    started = written = None
    with released_checkpoints():
        for number in range(max_rounds + 2):
            log = read_log(reached)
            first, end, count = log.agg(
                F.min("generation"), F.max("generation"), F.count_distinct("generation")).first()
            lag = 0 if end is None else end - reached
            final = number > 0 and lag <= max_lag
            if not final and number > max_rounds:
                raise CompactionError(f"{lag} generations behind after {max_rounds} rounds")
            if started is not None and time.monotonic() - started > max_seconds:
                raise CompactionError(f"{lag} generations behind after {max_seconds} seconds")
            if lag:
                # Rows that come while this round runs belong to the next one.
                log = log.where(F.col("generation") <= end)
                if first != reached + 1 or count != lag or not change_log_violations(log).isEmpty():
                    raise CompactionError(f"the log after generation {reached} is broken")
                # Each rewrite is a batch that nobody sees, since only the last one is committed.
                written = last + 1 + number
                table.write(_sorted(apply_change_log(rows, log)), written)
                rows = table.spark.read.schema(table.schema).parquet(
                    f"{table.path}/data/batch_id={written}")
                reached = end
            if final:
                break
            started = started or time.monotonic()
            between(number)
    found = audit(rows).limit(1).collect()
    if found:
        raise CompactionError(f"the rewritten snapshot fails its audit: {found[0]}")
    if written is not None:
        table.commit(written, reached)
    return reached
