"""Sessions and tables."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "eventloom", cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for one machine: UTC, adaptive execution, few shuffle partitions."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("EVENTLOOM_MEMORY", memory))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which driver and executors share; a local session without one gets a temporary folder, elsewhere that is an error."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        have = context._jsc.sc().getCheckpointDir()
        if have.isDefined():
            return have.get()
        if not re.fullmatch(r"local(\[[^]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="eventloom-")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Bytes of input files (rows take some times as much in memory) for a task of a shuffle; bytes counted for a row where sizes are unknown; sizes from which they are.
SHARE, ROW, UNKNOWN = 24 << 20, 16, 1 << 50


def _read(df: DataFrame) -> int:
    """Bytes of the tables that a frame is made of, without running it; from its rows where Spark does not know them."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    return sum(sizes) if max(sizes, default=0) < UNKNOWN else df.count() * ROW


def shares(*frames: DataFrame) -> int:
    """Partitions for a shuffle of these frames together: their number grows with the input, and is spark.sql.shuffle.partitions at least."""
    return max(int(frames[0].sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sum(map(_read, frames)) // SHARE))


def materialised(df: DataFrame) -> DataFrame:
    """The rows written once to the shared folder, with the lineage cut there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
