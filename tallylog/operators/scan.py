"""Ordered scans that never put a whole table, or a whole hot group, into one task.

A running total over a global order is usually written as a window without a partition, which
moves every row to one task. Here the order key is a number, so rows are cut into blocks of
``block`` consecutive numbers: the window runs inside a block, and the carry from earlier blocks
comes from a table with one row per (group, block). That table is built with map-side
pre-aggregation and has at most rows/block + groups entries, so its own window stays small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallylog.session import checkpointed

#: Rows of one block fit a task easily, and 10^12 rows make only 10^6 blocks.
BLOCK = 1 << 20


def running(
    df: DataFrame,
    order: str,
    by: list[str] | None = None,
    sums: dict[str, Column] | None = None,
    maxes: dict[str, Column] | None = None,
    block: int = BLOCK,
    before: bool = False,
) -> DataFrame:
    """Add running sums and maxima along ``order`` inside each group of ``by``.

    ``order`` must be a non-negative BIGINT, unique within a group. The row itself is included, or left out
    with ``before=True`` (a sum starts at 0, a maximum at NULL).
    """
    by, sums, maxes = by or [], sums or {}, maxes or {}
    df = df.withColumn("_block", F.expr(f"{_quote(order)} div {block}"))
    keys = [*by, "_block"]

    totals = df.groupBy(*keys).agg(
        *[F.sum(value).alias(f"_sum_{name}") for name, value in sums.items()],
        *[F.max(value).alias(f"_max_{name}") for name, value in maxes.items()],
    )
    earlier = Window.partitionBy(*by).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    carries = totals.select(
        *keys,
        *[
            F.coalesce(F.sum(f"_sum_{name}").over(earlier), F.lit(0)).alias(f"_sum_{name}")
            for name in sums
        ],
        *[F.max(f"_max_{name}").over(earlier).alias(f"_max_{name}") for name in maxes],
    )

    inside = Window.partitionBy(*keys).orderBy(order).rowsBetween(
        Window.unboundedPreceding, -1 if before else Window.currentRow
    )
    local = df.withColumns(
        {
            **{f"_in_{name}": F.sum(value).over(inside) for name, value in sums.items()},
            **{f"_in_{name}": F.max(value).over(inside) for name, value in maxes.items()},
        }
    )
    joined = _join_null_safe(local, carries, keys)
    joined = joined.withColumns(
        {
            **{
                name: F.coalesce(F.col(f"_in_{name}"), F.lit(0)) + F.col(f"_sum_{name}")
                for name in sums
            },
            **{
                name: F.greatest(F.col(f"_in_{name}"), F.col(f"_max_{name}")) for name in maxes
            },
        }
    )
    return joined.select(*[c for c in df.columns if c != "_block"], *sums, *maxes)


def _quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _join_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Equi-join on keys that may be NULL, keeping the left columns.

    Keys that are never NULL are compared plainly, so that the join keeps the partitioning of the
    windows before it and moves no row again.
    """
    renamed = right.select(
        *[F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)],
        *[c for c in right.columns if c not in keys],
    )
    condition = F.lit(True)
    for i, key in enumerate(keys):
        plain = key == "_block" or not left.schema[key].nullable
        same = left[key] == renamed[f"_r{i}"] if plain else left[key].eqNullSafe(renamed[f"_r{i}"])
        condition = condition & same
    return left.join(renamed, condition, "inner").drop(
        *[f"_r{i}" for i in range(len(keys))]
    )


def dense_sequence(
    df: DataFrame, order: str, name: str = "sequence", start: int | Column = 0,
    block: int = BLOCK,
) -> DataFrame:
    """Number rows start+1, start+2, … along ``order`` without a gap."""
    base = start if isinstance(start, Column) else F.lit(start)
    out = running(df, order, sums={"_rank": F.lit(1).cast("bigint")}, block=block)
    return out.withColumn(name, F.col("_rank") + base.cast("bigint")).drop("_rank")


def monotone_times(
    df: DataFrame, by: list[str], time: str, order: str, name: str, block: int = BLOCK,
    prior: DataFrame | None = None,
) -> DataFrame:
    """Strictly increasing times per group: p = max(t, previous p + 1) in arrival order.

    With r the arrival rank, p = r + running max(t - r). Rank and maximum are taken inside a
    block and shifted by the rows and the maximum of the earlier blocks. ``prior`` holds the last
    p of each group (columns of ``by`` and ``last``) from an earlier run.
    """
    df = df.withColumn("_block", F.expr(f"{_quote(order)} div {block}"))
    keys = [*by, "_block"]
    inside = Window.partitionBy(*keys).orderBy(order)
    local = df.withColumn("_rank", F.row_number().over(inside).cast("bigint")).withColumn(
        "_lead",
        F.max(F.col(time) - F.col("_rank")).over(
            inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ),
    )
    totals = local.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.max(F.col(time) - F.col("_rank")).alias("_top")
    )
    earlier = Window.partitionBy(*by).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    carries = totals.withColumn(
        "_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    ).select(
        *keys, "_offset", F.max(F.col("_top") - F.col("_offset")).over(earlier).alias("_prior")
    )
    if prior is not None:
        carries = carries.join(prior, by, "left").select(
            *keys, "_offset", F.greatest("_prior", "last").alias("_prior")
        )
    joined = _join_null_safe(local, carries, keys)
    lead = F.greatest(F.col("_prior"), F.col("_lead") - F.col("_offset"))
    joined = joined.withColumn(name, F.col("_offset") + F.col("_rank") + lead)
    return joined.select(*[c for c in df.columns if c != "_block"], name)


def sequence_gaps(df: DataFrame, sequence: str, first: Column, last: Column) -> DataFrame:
    """Missing ranges (gap_from, gap_through) of a positive number that should cover first..last.

    A block of 32 768 numbers is recognised as full from a bitmap built with map-side combining,
    so a healthy table costs one narrow scan and a shuffle of one small row per block and task.
    Only the rows of deficient blocks are compared one by one. ``first`` and ``last`` are literals.
    """
    inside = (
        df.select(F.col(sequence).alias("s"))
        .where((F.col("s") >= first) & (F.col("s") <= last))
        .withColumn("b", F.bitmap_bucket_number("s"))
    )
    blocks = inside.groupBy("b").agg(
        F.min("s").alias("low"),
        F.max("s").alias("high"),
        F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position("s"))).alias("n"),
    )
    between = running(
        blocks.select("b", "low", "high"), "b", maxes={"prev": F.col("high")}, before=True
    ).select(
        (F.coalesce("prev", first - 1) + 1).alias("gap_from"),
        (F.col("low") - 1).alias("gap_through"),
    )
    tail = blocks.agg(F.max("high").alias("top")).select(
        (F.coalesce("top", first - 1) + 1).alias("gap_from"), last.alias("gap_through")
    )
    deficient = blocks.where(F.col("high") - F.col("low") + 1 != F.col("n")).select("b")
    within = (
        inside.join(deficient, "b", "left_semi")
        .distinct()
        .select(
            (F.lag("s").over(Window.partitionBy("b").orderBy("s")) + 1).alias("gap_from"),
            (F.col("s") - 1).alias("gap_through"),
        )
    )
    return (
        between.unionByName(tail)
        .unionByName(within)
        .where(F.col("gap_from") <= F.col("gap_through"))
    )


def ordered_blocks(df: DataFrame, order: list[str]) -> DataFrame:
    """Range-partition by keys that are not numbers and number the rows with ``order_no``.

    The partition a row landed in must not change between the two passes of a scan, so it is
    written down with a reliable checkpoint. Rows are numbered inside their partition; the
    partition number is the high part, so ``order_no`` follows the order without being dense.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = (
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("order_no", F.monotonically_increasing_id())
    )
    return checkpointed(placed)


def file_order(rows: DataFrame, path: str, start: str, name: str = "arrival") -> DataFrame:
    """Number the rows of a file scan in file and line order, without moving them.

    ``path`` and ``start`` are columns with ``_metadata.file_path`` and ``file_block_start``. A task
    may read several pieces of files, in any order, but reads each piece from its start: the row
    counter of the task orders the rows of a piece, and the rank of (path, start) orders the
    pieces. Only this list, one row a piece, is ranked; with 128 MB pieces, 100 TB have 800 000.
    ``name`` is unique, ascending and not dense; above ``ORDERED_BLOCK`` it has the rank.
    """
    pieces = rows.select(F.col(path).alias("_p"), F.col(start).alias("_s")).distinct()
    ranked = checkpointed(
        pieces.select("_p", "_s", (F.row_number().over(Window.orderBy("_p", "_s")) - 1).alias("_rank"))
    )
    counted = rows.withColumn(
        "_row", F.monotonically_increasing_id().bitwiseAND(F.lit(ORDERED_BLOCK - 1))
    )
    placed = counted.join(ranked, (F.col(path) == F.col("_p")) & (F.col(start) == F.col("_s")))
    number = F.col("_rank").cast("bigint") * F.lit(ORDERED_BLOCK) + F.col("_row")
    return placed.withColumn(name, number).drop("_p", "_s", "_rank", "_row")


#: ``order_no`` keeps the partition above this bit, so it is also a block size for ``running``.
ORDERED_BLOCK = 1 << 33


def covered_prefix(ranges: DataFrame, start: str, end: str) -> DataFrame:
    """One row ``covered``: the end of the gap-free prefix 1..covered of overlapping ranges.

    Ranges with one start are first reduced to the longest, so starts are unique. The running
    maximum never falls, so the first hole has the smallest maximum of all holes.
    """
    longest = ranges.groupBy(F.col(start).alias("s")).agg(F.max(end).alias("e"))
    reached = running(longest, "s", maxes={"before": F.col("e")}, before=True)
    hole = F.col("s") > F.coalesce("before", F.lit(0)) + 1
    return reached.agg(
        F.coalesce(
            F.min(F.when(hole, F.coalesce("before", F.lit(0)))), F.max("e"), F.lit(0)
        ).cast("bigint").alias("covered")
    )


def disjoint_ranges(ranges: DataFrame, start: str, end: str) -> DataFrame:
    """The same numbers as disjoint, non-adjacent ranges (start, end), from overlapping ones.

    A range opens a new one when it starts beyond all earlier ends; ranges between two openings
    belong together.
    """
    longest = ranges.groupBy(F.col(start).alias("s")).agg(F.max(end).alias("e")).where("e >= s")
    reached = running(longest, "s", maxes={"before": F.col("e")}, before=True)
    opens = (F.col("before").isNull() | (F.col("s") > F.col("before") + 1)).cast("bigint")
    return (
        running(reached.withColumn("opens", opens), "s", sums={"island": F.col("opens")})
        .groupBy("island").agg(F.min("s").alias(start), F.max("e").alias(end)).drop("island")
    )


def broken_links(
    df: DataFrame, by: list[str], start: str, end: str, first: int = 1, block: int = BLOCK
) -> DataFrame:
    """Starts that do not follow right after the end of the entry before them in their group.

    Entries with one start are counted together (``copies``, longest end), so a repeated start is
    a broken link too. The first entry of a group must start at ``first``. The entry before is the
    largest (start, end) seen so far, so no self-join is needed.
    """
    entries = df.groupBy(*by, start).agg(F.max(end).alias(end), F.count(F.lit(1)).alias("copies"))
    linked = running(
        entries, start, by, maxes={"_previous": F.struct(F.col(start), F.col(end))},
        before=True, block=block,
    ).withColumn(
        "expected_start",
        F.coalesce(F.col(f"_previous.{end}") + 1, F.lit(first).cast("bigint")),
    )
    return linked.where(
        (F.col(start) != F.col("expected_start")) | (F.col("copies") > 1)
    ).drop("_previous")
