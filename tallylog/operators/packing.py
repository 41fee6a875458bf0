"""Size-bounded packing of an ordered table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tallylog.operators.scan import BLOCK, running


def pack_greedy(
    df: DataFrame, sequence: str, size: str, max_bytes: int, max_rows: int | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """Cut consecutive rows into parts of at most ``max_bytes`` (and ``max_rows``).

    Each part takes as many rows as fit, and at least one. That is sequential, so packing restarts
    at every block of ``block`` sequence numbers: blocks run in parallel, every size and continuity
    rule still holds, and only the last part of a block can be smaller than it had to be. Inside a
    block the work is one binary search per part over running sizes. Result: ``ordinal``,
    ``from_sequence``, ``through_sequence``, ``record_count``, ``plain_bytes``, ``byte_offset``.
    """
    rows = df.select(
        F.col(sequence).cast("bigint").alias("s"),
        F.col(size).cast("bigint").alias("n"),
        F.expr(f"`{sequence}` div {block}").alias("b"),
    )
    most = max_rows or block

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("s")
        numbers = pdf["s"].to_numpy()
        ends = pdf["n"].to_numpy().cumsum()
        starts, used, at = [0], 0, 0
        while at < len(ends):
            fit = int(np.searchsorted(ends, used + max_bytes, side="right"))
            at = min(max(fit, at + 1), at + most)
            used = int(ends[min(at, len(ends)) - 1])
            starts.append(min(at, len(ends)))
        first, last = np.array(starts[:-1]), np.array(starts[1:]) - 1
        return pd.DataFrame(
            {
                "from_sequence": numbers[first],
                "through_sequence": numbers[last],
                "record_count": last - first + 1,
                "plain_bytes": ends[last] - np.where(first > 0, ends[first - 1], 0),
            }
        )

    parts = rows.groupBy("b").applyInPandas(
        cut,
        "from_sequence bigint, through_sequence bigint, record_count bigint, plain_bytes bigint",
    )
    placed = running(
        parts, "from_sequence",
        sums={"ordinal": F.lit(1).cast("bigint"), "_end": F.col("plain_bytes")},
    )
    return placed.withColumn("byte_offset", F.col("_end") - F.col("plain_bytes")).drop("_end")
