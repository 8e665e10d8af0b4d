"""Compaction of tables, snapshots, a catalogue of tables and a store of jobs and metrics."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.sources import stores

TARGET_BYTES = 128 << 20


@dataclass(frozen=True)
class CompactionPlan:
    files: int
    bytes: int
    outputs: int

    @property
    def needed(self) -> bool:
        return self.files >= 2 and self.outputs < self.files


def sizes(spark: SparkSession, path: str) -> DataFrame:
    """path, length of a table's data files; the content is not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path).select("path", "length")


def plan_compaction(spark: SparkSession, path: str, target: int = TARGET_BYTES) -> CompactionPlan:
    row = sizes(spark, path).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("b")).first()
    return CompactionPlan(row["n"], row["b"], max(1, -(-row["b"] // target)))


def wants_compaction(plan: CompactionPlan, most_files: int = 50, least_mean: int = 64 << 20) -> bool:
    """Over so many files, or files smaller than so much on average."""
    return plan.needed and (plan.files > most_files or plan.bytes / plan.files < least_mean)


def compact(spark: SparkSession, path: str, to: str, target: int = TARGET_BYTES, sort_by: list[str] | None = None, dry_run: bool = False) -> CompactionPlan:
    """A table rewritten to `to` in files of about `target` bytes, sorted over range partitions if told. The old files stay until the caller swaps the folders."""
    plan = plan_compaction(spark, path, target)
    if not dry_run:
        df = spark.read.parquet(path)
        df = df.repartitionByRange(plan.outputs, *sort_by).sortWithinPartitions(*sort_by) if sort_by else df.repartition(plan.outputs)
        df.write.mode("overwrite").parquet(to)
    return plan


class Catalogue:
    """Tables as Parquet folders with snapshots: an append or overwrite makes a version, and older ones can be read."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _log(self) -> str:
        return f"{self.folder}/_log"

    def history(self) -> DataFrame:
        """table_name, version, path, mode, n_rows of every version."""
        schema = "table_name string, version int, path string, mode string, n_rows long"
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self._log())
        if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._log())

    def version(self, name: str) -> int:
        return self.history().where(F.col("table_name") == name).agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    def write(self, name: str, df: DataFrame, mode: str = "append") -> int:
        number = self.version(name) + 1
        path = f"{self.folder}/{name}/v{number}"
        df.write.parquet(path)
        n = self.spark.read.parquet(path).count()
        self._record(name, number, path, mode, n)
        return number

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """The rows as of a version: those since the last overwrite up to it."""
        rows = self.history().where((F.col("table_name") == name) & (F.col("version") <= (version or 1 << 30))).orderBy("version").collect()
        last = max((r["version"] for r in rows if r["mode"] in ("overwrite", "drop")), default=0)
        paths = [r["path"] for r in rows if r["version"] >= last and r["mode"] != "drop"]
        if not paths:
            raise ValueError(f"no table {name!r}")
        return self.spark.read.parquet(*paths)

    def tables(self, database: str | None = None) -> list[str]:
        """Names of the tables (of a database: without it) that are not dropped."""
        last = self.history().groupBy("table_name").agg(F.max_by("mode", "version").alias("mode")).where("mode <> 'drop'")
        names = sorted(r[0] for r in last.select("table_name").collect())  # a row a table
        return names if database is None else [n.split(".", 1)[1] for n in names if n.startswith(f"{database}.")]

    def _databases(self) -> str:
        return f"{self.folder}/_databases"

    def create_database(self, name: str, comment: str = "") -> None:
        """A database is a prefix of table names, with a description of its own."""
        if not name.isidentifier():
            raise ValueError(f"no name of a database: {name!r}")
        if name in self.databases():
            raise ValueError(f"there is a database {name!r}")
        stores.put(self.spark, f"{self._databases()}/{name}.json", json.dumps({"name": name, "comment": comment}).encode())

    def databases(self) -> list[str]:
        if not stores.exists(self.spark, self._databases()):
            return []
        return sorted(x.path.rsplit("/", 1)[-1].removesuffix(".json") for x in stores.listed(self.spark, self._databases()) if x.path.endswith(".json"))

    def create_table(self, database: str, name: str, df: DataFrame) -> int:
        """The first version of a new table of a database."""
        if database not in self.databases():
            raise ValueError(f"no database {database!r}")
        if name in self.tables(database):
            raise ValueError(f"there is a table {name!r}")
        return self.write(f"{database}.{name}", df, "overwrite")

    def drop_table(self, name: str) -> None:
        """Hides a table; its versions stay on disk for those who name them."""
        if name not in self.tables():
            raise ValueError(f"no table {name!r}")
        self._record(name, self.version(name) + 1, "", "drop", 0)

    def drop_database(self, name: str) -> None:
        """Drops an empty database."""
        if self.tables(name):
            raise ValueError(f"database {name!r} has tables")
        stores.delete(self.spark, f"{self._databases()}/{name}.json")

    def _record(self, name: str, number: int, path: str, mode: str, n: int) -> None:
        self.spark.createDataFrame([(name, number, path, mode, n)], "table_name string, version int, path string, mode string, n_rows long").write.mode("append").parquet(self._log())


def metric_stats(metrics: DataFrame) -> DataFrame:
    """name: mean, least, largest and number of its values."""
    return metrics.groupBy("name").agg(F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("largest"), F.count(F.lit(1)).alias("n"))


def job_stats(jobs: DataFrame) -> DataFrame:
    """Numbers of jobs by state and the rows of the finished ones."""
    return jobs.agg(F.count(F.lit(1)).alias("n_jobs"), F.count_if(F.col("state") == "done").alias("n_done"), F.count_if(F.col("state") == "failed").alias("n_failed"), F.coalesce(F.sum(F.when(F.col("state") == "done", F.col("n_rows"))), F.lit(0)).alias("n_rows"))
