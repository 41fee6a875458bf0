"""Connected components of a table of links, by alternating star contractions.

Each round points the larger neighbours of every node at its smallest neighbour, then does the same
with the smaller ones. Both are joins with a grouped minimum, so a hub of any degree is
pre-aggregated, and no group is ever gathered. Rounds are logarithmic in the longest path; each is
written to the checkpoint folder, so a lost executor repeats one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallylog.session import checkpointed


#: Links for one task. Contracted links are few and narrow, so they are kept in as few parts.
TASK_LINKS = 200_000


def _large_star(links: DataFrame, parts: int) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(parts)
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(
        F.col("v").alias("u"), F.col("m").alias("v")).coalesce(parts)


def _small_star(links: DataFrame, parts: int) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).coalesce(parts)


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): each linked node with the smallest node it can reach.

    Links with a null end or with two equal ends say nothing and are left out. Nodes without a link
    are not in the result.
    """
    ends = links.select(F.col(a).alias("a"), F.col(b).alias("b"))
    now = checkpointed(
        ends.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    seen = None
    while True:
        # At the end every node points at its component: a star of depth one, which stays.
        state = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state == seen or state[0] == 0:
            break
        seen, parts = state, -(-state[0] // TASK_LINKS)
        larger = _large_star(now.coalesce(parts), parts).distinct().coalesce(parts)
        now = checkpointed(_small_star(larger, parts).distinct().coalesce(parts))
    roots = now.select("v").distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select(F.col("v").alias("node"), F.col("v").alias("component"))
    )
