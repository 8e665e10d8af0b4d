"""Row numbers over data of any size: sorted in ranges by many tasks, numbered with the sizes of the ranges before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.session import materialised


def numbered(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """`df` with `name`: 1, 2, 3, ... in the order of the columns `order` (their values should be unique, or ties fall anyhow).

    Spark sorts in ranges; the sorted rows are written once, so that a task that runs again
    numbers the same rows. Only the sizes of the ranges, a row each, are summed in one task.
    """
    part, row = F.shiftrightunsigned("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    kept = materialised(df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id())).withColumn("__part", part)
    sizes = kept.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    return kept.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + row + 1).drop("__part", "__before", "__id")
