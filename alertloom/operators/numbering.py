"""Running numbers that need no single task and no hot group.

A window over one big group would sort that group in one task.  Here the order column
is a dense number, cut into blocks: counts per block are summed first, which leaves few
rows, and rows are numbered inside their block only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 65536


def _block(order: str, size: int) -> Column:
    return F.expr(f"`{order}` div {size}")


def running_offset(df: DataFrame, order: str, amount: Column, name: str, size: int = BLOCK) -> DataFrame:
    """Add ``name``: the sum of ``amount`` over all rows with a smaller ``order``."""
    cut = df.withColumn("_block", _block(order, size)).withColumn("_n", amount.cast("long"))
    totals = cut.groupBy("_block").agg(F.sum("_n").alias("_total"))
    # one row per block of ``size`` rows
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_block", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        cut.withColumn("_before", F.coalesce(F.sum("_n").over(within), F.lit(0)))
        .join(starts, "_block")
        .withColumn(name, F.col("_start") + F.col("_before"))
        .drop("_block", "_n", "_before", "_start")
    )


def position_in_group(df: DataFrame, key: str, order: str, name: str, size: int = BLOCK) -> DataFrame:
    """Add ``name``: the place of a row in its group by ``order``, counted from 1."""
    cut = df.withColumn("_block", _block(order, size))
    counts = cut.groupBy(key, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(key, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(key, "_block").orderBy(order)
    return (
        cut.withColumn("_row", F.row_number().over(within))
        .join(starts, [key, "_block"])
        .withColumn(name, F.col("_start") + F.col("_row"))
        .drop("_block", "_row", "_start")
    )
