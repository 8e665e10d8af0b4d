"""Prefix doubling over sequences, in DataFrame functions alone.

A position of a sequence has a rank, at first the name of its item. A position's rank for its
first h items and that of the position h items on form a pair; Spark sorts the pairs that occur
more than once, and their place in the order is the rank for 2 h items. Positions whose pair is
unique drop out, so each round is smaller than the one before, and the doubling ends at the
length asked for (the last step is shorter if need be).

Skew: counting combines before the shuffle. Ranks are handed back by a join in which ranks that
hold over a 4,096th of the rows (so at most 4,096 of them) are broadcast, and no other rank can fill a task.
Each round's ranks are written to the shared folder, as a lost executor must not change them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import materialised

#: A rank with more rows than this share of all (and than LEAST_HOT) is hot.
HOT_SHARE, LEAST_HOT = 4096, 1000


def split_hot(ranks: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """The rows of `ranks` (a key and n, its number of rows, `total` of them in all) that are hot, 4,096 at most, and the others."""
    most = max(LEAST_HOT, total // HOT_SHARE)
    return ranks.where(F.col("n") > most), ranks.where(F.col("n") <= most)


def join_ranks(rows: DataFrame, ranks: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Inner join of `rows` with one row of `ranks` a key; its column n is the key's number of rows, `total` in all."""
    hot, cold = split_hot(ranks, total)
    marked = rows.join(F.broadcast(hot), keys, "left")
    rest = marked.where("n is null").select(*rows.columns).join(cold, keys)
    return marked.where("n is not null").unionByName(rest)


def repeated(rows: DataFrame, sequence: list[str], length: int) -> tuple[DataFrame, int]:
    """The rows (columns `sequence` name a sequence; pos, at, rank) whose next `length` ranks stand elsewhere too, with the rank of those as `rank` and the last one's `at` as `upto`, and an upper bound of their number."""
    rows = materialised(rows)
    counted = materialised(rows.groupBy("rank").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    rows = join_ranks(rows, counted, ["rank"], total).drop("n")
    # all rows of a repeated stretch are left here, so its last one is found now
    final = Window.partitionBy(*sequence).orderBy("pos").rangeBetween(length - 1, length - 1)
    rows = rows.withColumn("upto", F.max("at").over(final))
    names = rows.columns
    h = 1
    while h < length:
        step = min(h, length - h)
        ahead = Window.partitionBy(*sequence).orderBy("pos").rangeBetween(step, step)
        paired = materialised(rows.withColumn("after", F.max("rank").over(ahead)).where("after is not null"))
        pairs = paired.groupBy("rank", "after").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        ranked = materialised(pairs.orderBy("rank", "after").select("rank", "after", "n", F.monotonically_increasing_id().alias("next")))
        total = ranked.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
        rows = join_ranks(paired, ranked, ["rank", "after"], total).select(*[F.col("next").alias("rank") if c == "rank" else F.col(c) for c in names])
        h += step
    return rows, total
