"""Process mining on event logs: statistics, variants, directly-follows graphs, gaps and bottlenecks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.log import in_case, traces


def distinct_counts(log: DataFrame) -> DataFrame:
    return log.agg(F.count(F.lit(1)).alias("n_events"), F.countDistinct("case_id").alias("n_cases"), F.countDistinct("activity").alias("n_activities"), F.countDistinct("resource").alias("n_resources"))


def time_range(log: DataFrame) -> DataFrame:
    return log.agg(F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"))


def events_per_case(log: DataFrame) -> DataFrame:
    """Smallest, largest and mean number of events of a case."""
    sizes = log.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.min("n").alias("min_events"), F.max("n").alias("max_events"), F.round(F.avg("n"), 6).alias("avg_events"))


def median_events(log: DataFrame) -> DataFrame:
    """The upper median of events per case from the (small) histogram of case sizes."""
    sizes = log.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("k"))
    order = Window.orderBy("n")
    upto = sizes.withColumn("upto", F.sum("k").over(order)).withColumn("all", F.sum("k").over(Window.partitionBy()))
    return upto.where(F.col("upto") > F.floor(F.col("all") / 2)).agg(F.min("n").alias("median_events"))


def activity_share(log: DataFrame, column: str = "activity", limit: int | None = None) -> DataFrame:
    """Count and percentage of the values of a column; the most frequent `limit`, ties by value."""
    counts = log.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    share = counts.withColumn("share", F.round(F.col("n").cast("double") * 100 / F.sum("n").over(Window.partitionBy()), 6))
    return share.orderBy(F.desc("n"), F.asc_nulls_last(column)).limit(limit) if limit else share


def variants(log: DataFrame, limit: int | None = None) -> DataFrame:
    """Activity sequences with the number and percentage of cases that follow them."""
    found = traces(log).select(F.array_join("trace", " -> ").alias("variant")).groupBy("variant").agg(F.count(F.lit(1)).alias("n_cases"))
    share = found.withColumn("share", F.round(F.col("n_cases").cast("double") * 100 / F.sum("n_cases").over(Window.partitionBy()), 6))
    return share.orderBy(F.desc("n_cases"), "variant").limit(limit) if limit else share


def follows(log: DataFrame) -> DataFrame:
    """The log with the next activity and time of its case."""
    return log.withColumn("next_activity", F.lead("activity").over(in_case())).withColumn("next_ts", F.lead("timestamp").over(in_case()))


def dfg(log: DataFrame, least: int = 1) -> DataFrame:
    """Edges of the directly-follows graph with their frequency, at least `least`."""
    edges = follows(log).where("next_activity is not null").groupBy("activity", "next_activity").agg(F.count(F.lit(1)).alias("edge_count"))
    return edges.where(F.col("edge_count") >= least) if least > 1 else edges


def ends(log: DataFrame) -> DataFrame:
    """How often each activity starts and ends a case."""
    first = F.row_number().over(in_case()) == 1
    last = F.lead("activity").over(in_case()).isNull() & F.lead("seq").over(in_case()).isNull()
    marked = log.select("activity", first.cast("int").alias("s"), last.cast("int").alias("e"))
    return marked.groupBy("activity").agg(F.sum("s").alias("n_starts"), F.sum("e").alias("n_ends")).where("n_starts + n_ends > 0")


def case_durations(log: DataFrame) -> DataFrame:
    """Start, end, duration (ns) and number of events of each case; events without a time do not count."""
    return log.where("timestamp > 0").groupBy("case_id").agg(F.min("timestamp").alias("start_ts"), F.max("timestamp").alias("end_ts"), F.count(F.lit(1)).alias("n_events")).withColumn("duration", F.col("end_ts") - F.col("start_ts"))


def exact_sum(column: str | Column) -> Column:
    """The sum of whole numbers, whatever its size: nanoseconds of some thousand cases exceed a long."""
    return F.sum((F.col(column) if isinstance(column, str) else column).cast("decimal(38,0)"))


def whole_mean(column: str | Column) -> Column:
    """The mean of whole numbers without its fraction."""
    return F.call_function("div", exact_sum(column), F.count(F.lit(1)))


def average_duration(log: DataFrame) -> DataFrame:
    return case_durations(log).agg(whole_mean("duration").alias("avg_duration"), F.count(F.lit(1)).alias("n_cases"))


def gaps(log: DataFrame) -> DataFrame:
    """Time since the event before in the case, 0 for the first."""
    return log.withColumn("since_previous", F.col("timestamp") - F.coalesce(F.lag("timestamp").over(in_case()), F.col("timestamp")))


def intervals(log: DataFrame) -> DataFrame:
    """Each event as an interval to the next of its case; the last has no length."""
    until = F.coalesce(F.lead("timestamp").over(in_case()), F.col("timestamp"))
    return log.select("case_id", "activity", "seq", F.col("timestamp").alias("start"), F.greatest(until, "timestamp").alias("end")).withColumn("duration", F.col("end") - F.col("start"))


def bottlenecks(spans: DataFrame, start: int | None = None, end: int | None = None, activities: list[str] | None = None, limit: int = 10) -> DataFrame:
    """Activities by total duration of their intervals in [start, end]: total (a decimal), count, whole mean, largest."""
    if start is not None:
        spans = spans.where(F.col("end") >= start)
    if end is not None:
        spans = spans.where(F.col("start") <= end)
    if activities is not None:
        spans = spans.where(F.col("activity").isin(activities))
    found = spans.groupBy("activity").agg(exact_sum("duration").alias("total_duration"), F.count(F.lit(1)).alias("n"), whole_mean("duration").alias("avg_duration"), F.max("duration").alias("max_duration"))
    return found.orderBy(F.desc("total_duration"), "activity").limit(limit)


def as_long(few: DataFrame, column: str) -> DataFrame:
    """A result of a few rows (held on the driver) with a whole decimal as a long, if all its values fit."""
    rows = few.collect()
    fit = all(r[column] is None or -(1 << 63) <= r[column] < 1 << 63 for r in rows)
    kept = few.sparkSession.createDataFrame(rows, few.schema)
    return kept.withColumn(column, F.col(column).cast("long")) if fit else kept


def sequence_bottlenecks(log: DataFrame, path: list[str], limit: int = 10) -> DataFrame:
    """Bottlenecks of the activities of a path, if some case starts with it; no rows otherwise."""
    some = traces(log).where(F.slice("trace", 1, len(path)) == F.array(*map(F.lit, path))).limit(1).select(F.lit(1).alias("one"))
    spans = intervals(log).where(F.col("activity").isin(path)).withColumn("one", F.lit(1))
    return bottlenecks(spans.join(some, "one", "left_semi"), limit=limit)


def out_of_order(log: DataFrame, ordinal: str = "seq") -> DataFrame:
    """How many events have a time before the latest one with a time that arrived just before them, over the whole log.

    The order is of arrival and global; ranges of `ordinal` are compared in parallel and each
    range hands its last time to the next.
    """
    timed = log.where("timestamp > 0").select(F.col(ordinal).alias("at"), "timestamp")
    ranged = timed.withColumn("part", F.floor(F.col("at") / 1_000_000))
    inside = Window.partitionBy("part").orderBy("at")
    stepped = ranged.withColumn("before", F.lag("timestamp").over(inside)).where("before is not null").agg(F.count_if(F.col("timestamp") < F.col("before")).alias("k"))
    edges = ranged.groupBy("part").agg(F.min_by("timestamp", "at").alias("first"), F.max_by("timestamp", "at").alias("last"))
    borders = edges.withColumn("before", F.lag("last").over(Window.orderBy("part"))).agg(F.count_if(F.col("first") < F.col("before")).alias("k"))
    return stepped.unionByName(borders).agg(F.sum("k").alias("n_out_of_order"))


def duplicates(log: DataFrame) -> DataFrame:
    """Events beyond the first with the same case, activity and time."""
    return log.groupBy("case_id", "activity", "timestamp").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"))


def report(log: DataFrame) -> DataFrame:
    """The analysis as (metric, value) rows: counts, time range, events per case, in one pass over cases."""
    cases = log.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("a"), F.max("timestamp").alias("b"))
    wide = cases.agg(F.sum("n").alias("n_events"), F.count("case_id").alias("n_cases"), F.min("a").alias("first_ts"), F.max("b").alias("last_ts"), F.min("n").alias("min_events"), F.max("n").alias("max_events"))
    return wide.unpivot([], wide.columns, "metric", "value")
