"""Numbers, neighbours and running sums in one order over all rows, without one task that sees them all.

Rows are cut into blocks that follow each other in the order: each block is a partition of a window, and what a block needs of those before
it comes from one row for each block. ``block`` must grow with ``order``, and be fine enough that one block fits a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _joined(rows: DataFrame, summary: DataFrame) -> DataFrame:
    return rows.join(summary, "_block")


def numbered(rows: DataFrame, block: Column, order: list[str], name: str = "n") -> DataFrame:
    """``rows`` with their number in the order, from 1."""
    rows = rows.withColumn("_block", block)
    sizes = rows.groupBy("_block").agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_block")) - F.col("_rows")  # a row for each block
    here = F.row_number().over(Window.partitionBy("_block").orderBy(*order))
    return _joined(rows.withColumn("_here", here), sizes.select("_block", before.alias("_before"))).withColumn(name, (F.col("_here") + F.col("_before")).cast("long")).drop("_block", "_here", "_before")


def with_previous(rows: DataFrame, block: Column, key: str, values: dict[str, Column]) -> DataFrame:
    """``rows`` with the values of the row before in the order of ``key``, under the given names; null in the first row."""
    rows = rows.withColumn("_block", block).withColumn("_mine", F.struct(*[v.alias(k) for k, v in values.items()]))
    lasts = rows.groupBy("_block").agg(F.max_by("_mine", key).alias("_last"))
    lasts = lasts.select("_block", F.lag("_last").over(Window.orderBy("_block")).alias("_earlier"))  # a row for each block
    inside = F.lag("_mine").over(Window.partitionBy("_block").orderBy(key))
    out = _joined(rows.withColumn("_inside", inside), lasts).withColumn("_was", F.coalesce("_inside", "_earlier"))
    return out.select(*[c for c in rows.columns if c not in ("_block", "_mine", *values)], *[F.col(f"_was.{k}").alias(k) for k in values])


def running_sum(rows: DataFrame, block: Column, key: str, value: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` up to themselves in the order of ``key``."""
    rows = rows.withColumn("_block", block)
    sums = rows.groupBy("_block").agg(F.sum(value).alias("_sum"))
    before = F.sum("_sum").over(Window.orderBy("_block")) - F.col("_sum")  # a row for each block
    inside = F.sum(value).over(Window.partitionBy("_block").orderBy(key))
    return _joined(rows.withColumn("_inside", inside), sums.select("_block", before.alias("_before"))).withColumn(name, F.col("_inside") + F.col("_before")).drop("_block", "_inside", "_before")
