"""Differences of two logs: activities, resources, counts and durations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.operators import mining


def _counts(log: DataFrame, column: str, side: str) -> DataFrame:
    return log.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias(f"{side}_n"))


def activity_changes(left: DataFrame, right: DataFrame, stable: float = 1.0) -> DataFrame:
    """Share of each activity in both logs, in percent, and what became of it; shares closer than `stable` points are stable."""
    both = _counts(left, "activity", "left").join(_counts(right, "activity", "right"), "activity", "full_outer").na.fill(0, ["left_n", "right_n"])
    everything = Window.partitionBy()
    share = lambda side: F.coalesce(F.col(f"{side}_n").cast("double") * 100 / F.nullif(F.sum(f"{side}_n").over(everything), F.lit(0)), F.lit(0.0))
    shared = both.withColumn("left_share", F.round(share("left"), 6)).withColumn("right_share", F.round(share("right"), 6)).withColumn("delta", F.round(share("right") - share("left"), 6))
    status = F.when(F.col("left_n") == 0, "new").when(F.col("right_n") == 0, "removed").when(F.abs("delta") < stable, "stable").when(F.col("delta") > 0, "increased").otherwise("decreased")
    return shared.withColumn("status", status)


def resource_changes(left: DataFrame, right: DataFrame, stable: float = 5.0) -> DataFrame:
    """Events of each resource in both logs and the relative change in percent; below `stable` is stable."""
    both = _counts(left, "resource", "left").join(_counts(right, "resource", "right"), "resource", "full_outer").na.fill(0, ["left_n", "right_n"])
    delta = F.when(F.col("left_n") == 0, F.lit(100.0)).otherwise((F.col("right_n") - F.col("left_n")).cast("double") * 100 / F.nullif(F.col("left_n"), F.lit(0)))
    changed = both.withColumn("delta", F.round(delta, 6))
    status = F.when(F.col("left_n") == 0, "new").when(F.col("right_n") == 0, "removed").when(F.abs("delta") < stable, "stable").when(F.col("delta") > 0, "increased").otherwise("decreased")
    return changed.withColumn("status", status)


def only_in(left: DataFrame, right: DataFrame, column: str = "activity") -> DataFrame:
    """Values of a column that one log has and the other lacks, with the side that has them."""
    a, b = left.select(column).distinct(), right.select(column).distinct()
    return a.join(b, column, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, column, "left_anti").withColumn("side", F.lit("right")))


def summary(left: DataFrame, right: DataFrame) -> DataFrame:
    """side, n_events, n_cases, first_ts, last_ts, avg_duration of both logs."""

    def one(log: DataFrame, side: str) -> DataFrame:
        cases = log.where("timestamp > 0").groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("a"), F.max("timestamp").alias("b"))
        return cases.agg(F.sum("n").alias("n_events"), F.count(F.lit(1)).alias("n_cases"), F.min("a").alias("first_ts"), F.max("b").alias("last_ts"), mining.whole_mean(F.col("b") - F.col("a")).alias("avg_duration")).withColumn("side", F.lit(side))

    return one(left, "left").unionByName(one(right, "right"))


def hybrid(left: DataFrame, right: DataFrame, change: float = 0.1, most: int = 10, max_depth: int | None = None) -> DataFrame:
    """The hybrid difference as (kind, name, left_value, right_value): time ranges that changed, nodes of the prefix trees by status, and those of the `most` slowest steps of either log whose mean duration changed by over `change` (or that only one has)."""
    from eventloom.operators import tree

    ends = lambda log, side: log.where("timestamp > 0").agg(F.min("timestamp").alias("first event"), F.max("timestamp").alias("last event")).select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias(f"{side}_value")) for c in ("first event", "last event")])).alias("x")).select("x.*")
    ranges = ends(left, "left").join(ends(right, "right"), "name").where("left_value <> right_value").select(F.lit("time range").alias("kind"), "name", "left_value", "right_value")
    nodes = tree.compare(left, right, max_depth=max_depth).groupBy("status").agg(F.count(F.lit(1)).cast("double").alias("n")).select(F.lit("nodes").alias("kind"), F.col("status").alias("name"), F.lit(None).cast("double").alias("left_value"), F.col("n").alias("right_value"))

    def slow(log: DataFrame, side: str) -> DataFrame:
        steps = mining.intervals(log).groupBy("activity").agg(F.avg(F.col("end") - F.col("start")).alias(f"{side}_value"), F.count(F.lit(1)).alias("n"))
        rank = F.row_number().over(Window.orderBy(F.desc(f"{side}_value"), "activity"))  # a row an activity
        return steps.select(F.col("activity").alias("name"), f"{side}_value", rank.alias(f"{side}_rank"))

    both = slow(left, "left").join(slow(right, "right"), "name", "full_outer").where(f"left_rank <= {most} or right_rank <= {most}")
    moved = F.col("left_value").isNull() | F.col("right_value").isNull() | (F.abs(F.col("right_value") - F.col("left_value")) > F.lit(change) * F.col("left_value"))
    slower = both.where(moved).select(F.lit("bottleneck").alias("kind"), "name", F.round("left_value", 3).alias("left_value"), F.round("right_value", 3).alias("right_value"))
    return ranges.unionByName(nodes).unionByName(slower)


def text_report(left: DataFrame, right: DataFrame, most: int = 20) -> str:
    """The differences as text: a line per log and per changed activity, the largest changes first."""
    lines = [f"{r.side}: {r.n_events} events, {r.n_cases} cases, average duration {r.avg_duration} ns" for r in summary(left, right).orderBy("side").collect()]
    changed = activity_changes(left, right).where("status <> 'stable'").orderBy(F.abs("delta").desc(), "activity").limit(most)
    lines += [f"{r.status} {r.activity}: {r.left_share:.2f}% -> {r.right_share:.2f}%" for r in changed.collect()]
    return "\n".join(lines)
