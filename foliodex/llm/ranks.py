"""Ranks within groups of any size, without a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one cell of a group holds on average at most.
CELL = 200_000


def ranked(df: DataFrame, group: str, order: list[str], rows: int, name: str = "rank") -> DataFrame:
    """``df`` with ``name``, the 0-based number of each row in its ``group``.

    A group is cut by a hash of ``order`` into cells; a row's number is its number in the cell plus the
    sizes of the cells before it. Only sizes of cells cross between cells. ``rows`` is the number of rows.
    """
    cells = -(-rows // CELL) or 1
    cut = df.withColumn("_cell", F.pmod(F.xxhash64(*order), F.lit(cells)))
    sizes = cut.groupBy(group, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(group, "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(group, "_cell").orderBy(*order)
    return (
        cut.withColumn("_number", F.row_number().over(inside) - 1)
        .join(offsets, [group, "_cell"])
        .withColumn(name, F.col("_before") + F.col("_number"))
        .drop("_cell", "_number", "_before")
    )
