"""Star-schema export of an event log: three dimensions with surrogate keys, a time dimension and the facts.

Surrogate keys are numbers in order of the natural key. Facts join the dimensions that are
written, on names with null resources as `Unknown`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.log import as_timestamp, in_case
from eventloom.operators.numbering import numbered

UNKNOWN = "Unknown"


def _numbered(df: DataFrame, name: str, key: str) -> DataFrame:
    """Activities, resources and days are few, so one task numbers them."""
    return df.withColumn(key, F.row_number().over(Window.orderBy(name)))


def dim_cases(log: DataFrame) -> DataFrame:
    cases = log.groupBy("case_id").agg(F.min("timestamp").alias("start_ts"), F.max("timestamp").alias("end_ts"), F.count(F.lit(1)).alias("event_count"))
    cases = cases.withColumn("duration_seconds", F.round((F.col("end_ts") - F.col("start_ts")) / 1e9, 6))
    return numbered(cases, ["case_id"], "case_key").withColumn("case_key", F.col("case_key").cast("int"))


def dim_activities(log: DataFrame) -> DataFrame:
    return _numbered(log.groupBy(F.col("activity").alias("activity_name")).agg(F.count(F.lit(1)).alias("occurrence_count")), "activity_name", "activity_key")


def dim_resources(log: DataFrame) -> DataFrame:
    return _numbered(log.groupBy(F.coalesce("resource", F.lit(UNKNOWN)).alias("resource_name")).agg(F.count(F.lit(1)).alias("event_count")), "resource_name", "resource_key")


def dim_time(log: DataFrame) -> DataFrame:
    days = log.where("timestamp > 0").select(F.date_trunc("day", as_timestamp("timestamp")).cast("date").alias("date")).distinct()
    day = F.dayofweek("date") - 1
    parts = days.select(
        "date",
        F.year("date").alias("year"),
        F.quarter("date").alias("quarter"),
        F.month("date").alias("month"),
        F.dayofmonth("date").alias("day"),
        day.alias("day_of_week"),
        F.weekofyear("date").alias("week"),
        day.isin(0, 6).alias("is_weekend"),
        F.concat(F.lit("Q"), F.quarter("date")).alias("quarter_name"),
        F.date_format("date", "MMMM").alias("month_name"),
    )
    return _numbered(parts, "date", "time_key")


def fact_events(log: DataFrame, cases: DataFrame | None = None, activities: DataFrame | None = None, resources: DataFrame | None = None, times: DataFrame | None = None) -> DataFrame:
    """Event rows with the dimensions' keys, the time and the time since the event before in the case."""
    cases, activities, resources, times = cases or dim_cases(log), activities or dim_activities(log), resources or dim_resources(log), times or dim_time(log)
    before = F.lag("timestamp").over(in_case())
    rows = log.withColumn("previous_ts", before).withColumn("since_previous", F.col("timestamp") - F.coalesce(before, F.col("timestamp")))
    rows = rows.withColumn("resource_name", F.coalesce("resource", F.lit(UNKNOWN))).withColumn("date", F.date_trunc("day", as_timestamp("timestamp")).cast("date")).withColumnRenamed("activity", "activity_name")
    keyed = (
        rows.join(cases.select("case_id", "case_key"), "case_id", "left")
        .join(activities.select("activity_name", "activity_key"), "activity_name", "left")
        .join(resources.select("resource_name", "resource_key"), "resource_name", "left")
        .join(times.select("date", "time_key"), "date", "left")
    )
    return keyed.select("seq", "case_key", "activity_key", "resource_key", "time_key", "timestamp", "previous_ts", "since_previous")


def with_fact_key(facts: DataFrame) -> DataFrame:
    """Facts with fact_key: 1, 2, 3, ... in order of seq."""
    return numbered(facts, ["seq"], "fact_key")


def export(log: DataFrame, folder: str) -> list[str]:
    """The five tables as Parquet below `folder`; returns their paths."""
    dims = {"dim_cases": dim_cases(log), "dim_activities": dim_activities(log), "dim_resources": dim_resources(log), "dim_time": dim_time(log)}
    tables = {**dims, "fact_events": with_fact_key(fact_events(log, *dims.values()))}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return [f"{folder}/{name}" for name in tables]
