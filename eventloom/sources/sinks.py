"""Writers: Parquet with lineage, partitioned tables with a manifest, Arrow files, dead letters."""

from __future__ import annotations

import json
import time
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from eventloom.sources import stores

#: Names of codecs and what Spark calls them.
CODECS = {"none": "uncompressed", "uncompressed": "uncompressed", "snappy": "snappy", "gzip": "gzip", "gz": "gzip", "lz4": "lz4_raw", "zstd": "zstd", "brotli": "brotli"}


def codec(name: str) -> str:
    if name.lower() not in CODECS:
        raise ValueError(f"unknown codec {name!r}")
    return CODECS[name.lower()]


def write_parquet(df: DataFrame, path: str, compression: str = "zstd", lineage: dict[str, Any] | None = None, sort_by: list[str] | None = None) -> None:
    """Parquet; lineage goes to the metadata of every column. Sorted within files by `sort_by`, over range partitions of the first of them."""
    if lineage:
        df = df.select(*[F.col(f"`{c}`").alias(c, metadata={**(df.schema[c].metadata or {}), "lineage": {k: str(v) for k, v in lineage.items()}}) for c in df.columns])
    if sort_by:
        df = df.repartitionByRange(sort_by[0]).sortWithinPartitions(*sort_by)
    df.write.mode("overwrite").option("compression", codec(compression)).parquet(path)


def lineage_of(df: DataFrame) -> dict[str, str]:
    return next((f.metadata["lineage"] for f in df.schema if "lineage" in (f.metadata or {})), {})


def partition_value(column: str, transform: str = "identity", buckets: int = 16, width: int = 10) -> Column:
    """The value by which rows are filed: identity, year, month, day, hour, bucket (of a hash) or truncate."""
    c = F.col(column)
    formats = {"year": "yyyy", "month": "yyyy-MM", "day": "yyyy-MM-dd", "hour": "yyyy-MM-dd-HH"}
    if transform in formats:
        return F.date_format(c.cast("timestamp"), formats[transform])
    if transform == "bucket":
        return F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")
    if transform == "truncate":
        return F.substring(c.cast("string"), 1, width)
    if transform == "identity":
        return c
    raise ValueError(f"unknown transform {transform!r}")


def write_table(df: DataFrame, path: str, by: dict[str, str] | None = None, rows_per_file: int = 1_000_000, spread: int = 4) -> None:
    """A table of Parquet files in folders name=value by `by` (column -> transform), each of so many rows at most.

    Rows are dealt by folder before they are written, so that a task does not open a file in
    every folder; a folder's rows go to `spread` tasks at most, and adaptive execution splits those that are still large.
    """
    names = []
    for column, transform in (by or {}).items():
        name = column if transform == "identity" else f"{column}_{transform}"
        df = df.withColumn(name, partition_value(column, transform))
        names.append(name)
    if names:
        df = df.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(spread))).hint("rebalance", *names, "__salt").drop("__salt")
    writer = df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file)
    (writer.partitionBy(*names) if names else writer).parquet(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """file, n_rows of each data file of a table."""
    return spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n_rows"))


def write_arrow(df: DataFrame, path: str, most_rows: int = 1_000_000) -> int:
    """A small result as one Arrow file; returns its rows. Fails if there are more than `most_rows`: larger ones go by :func:`write_arrow_parts`."""
    import io

    import pyarrow as pa

    if df.limit(most_rows + 1).count() > most_rows:
        raise ValueError(f"more than {most_rows} rows")
    table, out = df.toArrow(), io.BytesIO()
    with pa.ipc.new_file(out, table.schema) as writer:
        writer.write_table(table)
    stores.put(df.sparkSession, path, out.getvalue())
    return table.num_rows


def arrow_parts(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """part (bytes of an Arrow stream with up to so many rows), n_rows: made by the executors, a part at a time."""
    import pyarrow as pa

    def run(batches):
        held, n = [], 0

        def made():
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, held[0].schema) as writer:
                for batch in held:
                    writer.write_batch(batch)
            return pa.RecordBatch.from_pydict({"part": [out.getvalue().to_pybytes()], "n_rows": pa.array([n], pa.int64())})

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= rows:
                yield made()
                held, n = [], 0
        if n:
            yield made()

    return df.mapInArrow(run, "part binary, n_rows long")


def read_arrow_parts(parts: DataFrame, schema: str) -> DataFrame:
    """The rows of :func:`arrow_parts`."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                yield from pa.ipc.open_stream(data.as_buffer())

    return parts.select("part").mapInArrow(run, schema)


def discard(df: DataFrame) -> int:
    """Runs a plan to its end and keeps nothing; returns how many rows there were."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
    return seen.get["n"]


def write_dead_letters(bad: DataFrame, path: str, error: str = "error", source: str = "", per_file: int = 100_000) -> None:
    """Bad rows as JSON lines: the row, its error, type, whether it can be mended, source and time."""
    row = F.to_json(F.struct(*[F.col(c) for c in bad.columns if c != error]))
    kind = F.when(F.col(error).contains("time"), "invalid_timestamp").when(F.col(error).contains("column"), "malformed_row").otherwise("unknown")
    rows = bad.select(F.col(error).alias("error"), kind.alias("error_type"), (kind != "unknown").alias("recoverable"), F.lit(source).alias("source"), F.lit(int(time.time())).alias("at"), row.alias("row"))
    rows.write.mode("append").option("maxRecordsPerFile", per_file).json(path)


def quarantine(bad: DataFrame, folder: str, source: str, error: str = "error") -> None:
    """Bad rows of a source as files of their own, by source and kind of error: the row as JSON, its error, and where it stood if `_metadata` tells."""
    kind = F.regexp_replace(F.regexp_replace(F.lower(F.col(error)), "[^a-z0-9]+.*$", ""), "^$", "unknown")
    row = F.to_json(F.struct(*[F.col(c) for c in bad.columns if c != error]))
    bad.select(F.lit(source).alias("source"), kind.alias("kind"), F.col(error).alias("error"), row.alias("row")).write.mode("append").partitionBy("source", "kind").json(folder)


def quarantined(spark: SparkSession, folder: str, source: str | None = None) -> DataFrame:
    """source, kind, error, row of the rows in quarantine."""
    rows = spark.read.schema("error string, row string, source string, kind string").json(folder)
    return rows.where(F.col("source") == source) if source else rows


def read_dead_letters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("error string, error_type string, recoverable boolean, source string, at long, row string").json(path)


def summarise_dead_letters(rows: DataFrame) -> DataFrame:
    """error_type, source: how many, how many recoverable, the oldest and newest."""
    return rows.groupBy("error_type", "source").agg(F.count(F.lit(1)).alias("n"), F.count_if("recoverable").alias("n_recoverable"), F.min("at").alias("oldest"), F.max("at").alias("newest"))


def sidecar(df: DataFrame, created: str) -> str:
    """What a table's description says: version, time, and fields, as JSON."""
    return json.dumps({"version": 1, "created_at": created, "fields": [{"name": f.name, "type": f.dataType.simpleString(), "nullable": f.nullable} for f in df.schema]}, sort_keys=True)
