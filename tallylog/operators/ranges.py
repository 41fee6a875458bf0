"""Look-up of numbers in ranges without comparing every row with every range."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Cells of one range: 10^12 numbers in the default cell need 15 million.
MAX_CELLS = 1 << 24


def in_ranges(
    rows: DataFrame, number: str, ranges: DataFrame, start: str, end: str,
    cell: int = 1 << 16, how: str = "inner",
) -> DataFrame:
    """Join rows to the ranges that contain their number (``start <= number <= end``).

    Ranges are repeated once per cell of ``cell`` numbers they touch, and both sides are
    equi-joined on the cell, so rows meet only the ranges near them and cells spread evenly.
    ``how`` is ``inner``, ``left``, ``left_semi`` or ``left_anti``. A range over ``MAX_CELLS`` cells
    would be repeated without bound and fails the job: choose a larger cell or merge ranges.
    """
    cells_of = F.expr(f"`{end}` div {cell} - `{start}` div {cell} + 1")
    ranges = ranges.where(
        F.when(cells_of > MAX_CELLS, F.raise_error(F.lit(f"range of over {MAX_CELLS} cells")))
        .otherwise(F.lit(True)).cast("boolean") & (F.col(end) >= F.col(start))
    )
    cells = ranges.withColumn(
        "_cell",
        F.explode(F.sequence(F.expr(f"`{start}` div {cell}"), F.expr(f"`{end}` div {cell}"))),
    )
    keyed = rows.withColumn("_row_cell", F.expr(f"`{number}` div {cell}"))
    condition = (
        (keyed["_row_cell"] == cells["_cell"])
        & (keyed[number] >= cells[start])
        & (keyed[number] <= cells[end])
    )
    return keyed.join(cells, condition, how).drop("_cell", "_row_cell")
