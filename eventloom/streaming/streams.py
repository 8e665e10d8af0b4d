"""Structured Streaming over folders of event files."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_folder(spark: SparkSession, path: str, schema, kind: str = "parquet", files_per_trigger: int | None = None, glob: str | None = None, bytes_per_trigger: int | None = None) -> DataFrame:
    """A stream of the files of a folder, at most so many (or so many bytes of them) a trigger."""
    reader = spark.readStream.format(kind).schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", bytes_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def deduplicated(stream: DataFrame, keys: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key; keys are kept as long as rows may be late."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, time: str, by: str, size: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Rows by tumbling (or sliding) window and key."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    return stream.withWatermark(time, late).groupBy(window.alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", by, "n")


def session_counts(stream: DataFrame, time: str, by: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Rows by session: a key's rows with gaps below `gap`."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", by, "n")


def directly_follows(stream: DataFrame, case_id: str = "case_id", activity: str = "activity", timestamp: str = "timestamp", seq: str = "seq") -> DataFrame:
    """case_id, activity, next_activity of each step, as events arrive: the state of a case is its last event.

    A case's events of one trigger come in pieces and in any order (of files and of their splits); they are put in order together.
    """

    def step(key: tuple, batches, state: GroupState):
        last = state.get[0] if state.exists else None
        acts = pd.concat([pdf[[timestamp, seq, activity]] for pdf in batches]).sort_values([timestamp, seq])[activity].tolist()
        chain = ([last] if last is not None else []) + acts
        if len(chain) > 1:
            yield pd.DataFrame({"case_id": [key[0]] * (len(chain) - 1), "activity": chain[:-1], "next_activity": chain[1:]})
        if chain:
            state.update((chain[-1],))

    return stream.groupBy(case_id).applyInPandasWithState(step, "case_id string, activity string, next_activity string", "last string", "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", kind: str = "parquet") -> None:
    """Everything that has arrived, written to files; a later call goes on from the checkpoint."""
    query = stream.writeStream.format(kind).option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()


def for_each_batch(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str = "update") -> None:
    """Everything that has arrived, batch by batch, to a function."""
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
