"""Chat formatting after collapsing cumulative snapshots, with DataFrame functions only.

A chat service may log a conversation again after every turn, each time as a conversation of its
own. Such snapshots are recognised by rolling prefix hashes: every turn has two 64-bit hashes of its
number, role and text, and the prefix up to a turn is the running sum of their 32-bit parts. A
conversation whose full hash is the hash of a proper prefix of another one is left out by an
anti-join; of equal conversations the one with the smallest id stays. The rest is rendered.

Running sums are taken in blocks of turn numbers with carries, full hashes and sets of prefix hashes
by grouped aggregates, so neither a long conversation nor a common first turn gathers in one task:
both sides of the anti-join are unique by their hash. Text is moved once, for the conversations that
stay, and is put together by blocks of turns first.

Edge cases: a null role reads as ``unknown`` and a null text as empty. Rows without a conversation
or turn number cannot be placed and are left out. Exactly repeated rows count once; different rows
with one turn number all stay, ordered by role and text. Turn numbers may start anywhere and have
gaps, but equal conversations number their turns alike. An empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallylog.session import checkpointed

#: Turns that are put together, and summed up, before a conversation is.
TURN_BLOCK = 1024

#: Marks of the rendered text.
TURN_START, TURN_END = "<|im_start|>", "<|im_end|>"

_PARTS = ("h0", "h1", "h2", "h3")


def rendered_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(TURN_START), role, F.lit("\n"), text, F.lit(f"{TURN_END}\n"))


def placed_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of the rows that have a place, without nulls."""
    return turns.where("conv_id is not null and turn is not null").select(
        "conv_id",
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit("unknown")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def prefix_hashes(placed: DataFrame) -> DataFrame:
    """(conv_id, turn, n, hash): rows up to each turn of each conversation and their hash."""
    whole = placed.select(
        "conv_id", "turn",
        F.xxhash64("turn", "role", "text").alias("a"),
        F.xxhash64(F.lit("second"), "text", "turn", "role").alias("b"),
    ).distinct()
    low, high = F.lit(0xFFFFFFFF).cast("bigint"), 32
    parts = [
        F.col("a").bitwiseAND(low), F.shiftrightunsigned("a", high),
        F.col("b").bitwiseAND(low), F.shiftrightunsigned("b", high),
    ]
    by_turn = whole.groupBy("conv_id", "turn").agg(
        F.count(F.lit(1)).alias("rows"), *[F.sum(p).alias(n) for p, n in zip(parts, _PARTS)]
    )
    # Running sums inside blocks of turn numbers, and the sums of all earlier blocks.
    summed = ["rows", *_PARTS]
    blocked = by_turn.withColumn("block", F.floor(F.col("turn") / TURN_BLOCK))
    inside = Window.partitionBy("conv_id", "block").orderBy("turn").rowsBetween(
        Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1)
    carries = blocked.groupBy("conv_id", "block").agg(*[F.sum(c).alias(c) for c in summed]).select(
        "conv_id", "block",
        *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"before_{c}") for c in summed])
    running = blocked.select(
        "conv_id", "turn", "block", *[F.sum(c).over(inside).alias(c) for c in summed])
    n, *parts = [F.col(c) + F.col(f"before_{c}") for c in summed]
    return running.join(carries, ["conv_id", "block"]).select(
        "conv_id", "turn", n.alias("n"),
        F.struct(n.alias("n"), *[p.alias(f"p{i}") for i, p in enumerate(parts)]).alias("hash"),
    )


def maximal_conversations(placed: DataFrame) -> DataFrame:
    """(conv_id, n_turns, copies) of the conversations that no longer one continues."""
    prefixes = checkpointed(prefix_hashes(placed))
    full = prefixes.groupBy("conv_id").agg(
        F.max("turn").alias("last"), F.max_by("hash", "turn").alias("hash")
    )
    ends = full.select("conv_id", "last")
    proper = prefixes.join(ends, "conv_id").where("turn < last").select("hash").distinct()
    once = full.groupBy("hash").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies")
    )
    return once.join(proper, "hash", "left_anti").select(
        "conv_id", F.col("hash.n").alias("n_turns"), "copies"
    )


def render(placed: DataFrame, chosen: DataFrame) -> DataFrame:
    """The chosen conversations with their ``text``: all turns in order."""
    block = F.floor(F.col("turn") / TURN_BLOCK)
    told = F.expr("transform(rows, r -> r.told)")
    return (
        placed.join(chosen.select("conv_id"), "conv_id", "left_semi")
        .select("conv_id", block.alias("block"), F.struct(
            "turn", "role", "text", rendered_turn(F.col("role"), F.col("text")).alias("told")
        ).alias("row"))
        .groupBy("conv_id", "block").agg(F.array_sort(F.collect_set("row")).alias("rows"))
        .select("conv_id", F.struct("block", F.concat_ws("", told).alias("told")).alias("row"))
        .groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))
        .select("conv_id", F.concat_ws("", told).alias("text"))
    )


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation that stays: conv_id, n_turns, copies and text."""
    placed = placed_turns(turns)
    chosen = checkpointed(maximal_conversations(placed))
    return chosen.join(render(placed, chosen), "conv_id")


FORMAT_SQL = f"""
with r as (
  select distinct conv_id, turn, coalesce(role, 'unknown') as role, coalesce(text, '') as text
  from conversations where conv_id is not null and turn is not null),
full_text as (
  select conv_id, count(*) as n_turns, max(turn) as last,
    list(struct_pack(turn := turn, role := role, text := text) order by turn, role, text) as said
  from r group by conv_id),
proper as (
  select distinct f.said[1:p.n] as said from full_text f,
    (select conv_id, turn, sum(count(*)) over (partition by conv_id order by turn) as n
     from r group by conv_id, turn) p
  where p.conv_id = f.conv_id and p.turn < f.last),
once as (
  select min(conv_id) as conv_id, count(*) as copies, said from full_text group by said)
select o.conv_id, f.n_turns, o.copies,
  array_to_string(list_transform(o.said,
    lambda x: '{TURN_START}' || x.role || chr(10) || x.text || '{TURN_END}' || chr(10)), '') as text
from once o join full_text f on f.conv_id = o.conv_id
where o.said not in (select said from proper)
"""
