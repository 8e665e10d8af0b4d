"""Pipelines: chains of frame-to-frame functions with hooks, observed while they run."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from eventloom.session import materialised

Step = Callable[[DataFrame], DataFrame]

#: Named bundles of session settings for ingest (see :mod:`eventloom.plans.ingest`, whose presets also choose reader and writer).
PRESETS = {
    "high_speed": {"spark.sql.files.maxPartitionBytes": "256m", "spark.sql.parquet.compression.codec": "snappy"},
    "high_quality": {"spark.sql.files.maxPartitionBytes": "128m", "spark.sql.parquet.compression.codec": "zstd"},
    "low_memory": {"spark.sql.files.maxPartitionBytes": "16m", "spark.sql.parquet.columnarReaderBatchSize": "1024"},
}

PLUGINS: dict[str, Step] = {}


def plugin(name: str) -> Callable[[Step], Step]:
    """Registers a step under a name."""

    def add(step: Step) -> Step:
        PLUGINS[name] = step
        return step

    return add


@dataclass
class Pipeline:
    """Steps in order; hooks see (or change) the frame before and after them. Nothing runs until a sink does."""

    steps: list[Step | str] = field(default_factory=list)
    before: list[Step] = field(default_factory=list)
    after: list[Step] = field(default_factory=list)

    def then(self, step: Step | str) -> Pipeline:
        self.steps.append(step)
        return self

    def apply(self, df: DataFrame) -> DataFrame:
        for step in [*self.before, *self.steps, *self.after]:
            df = df.transform(PLUGINS[step] if isinstance(step, str) else step)
        return df

    def observed(self, df: DataFrame) -> tuple[DataFrame, Observation]:
        """The result with an observation of its rows, filled when an action runs."""
        seen = Observation()
        return self.apply(df).observe(seen, F.count(F.lit(1)).alias("n_rows")), seen


def configure(spark, preset: str) -> None:
    for key, value in PRESETS[preset].items():
        spark.conf.set(key, value)


def processor(f: Callable[[dict], dict | None], schema: str | None = None) -> Step:
    """A step from a function of one event (a dict): what it returns stands for the event, None drops it. Events go through Python in Arrow batches; `schema` is that of the result where it differs."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    def step(df: DataFrame) -> DataFrame:
        out = df.sparkSession.createDataFrame([], schema).schema if schema else df.schema
        arrow = to_arrow_schema(out)

        def run(batches):
            for batch in batches:
                rows = [made for row in batch.to_pylist() if (made := f(row)) is not None]
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

        return df.mapInArrow(run, out)

    return step


def safe(step: Step, instead: Step | None = None) -> Step:
    """A step that lets the frame pass (or another step stand in) where it cannot be planned: a missing column, a wrong type."""

    def run(df: DataFrame) -> DataFrame:
        try:
            return step(df)
        except (AnalysisException, ValueError, KeyError, TypeError):
            return instead(df) if instead else df

    return run


def checkpointed(step: Step) -> Step:
    """A step whose result is written to the shared folder, so that what follows does not run it again."""
    return lambda df: materialised(step(df))


@dataclass
class Trace:
    """The steps that ran: name, columns before and after, and the rows once an action has run."""

    spans: list[dict] = field(default_factory=list)

    def traced(self, name: str, step: Step) -> Step:
        def run(df: DataFrame) -> DataFrame:
            seen, out = Observation(), step(df)
            self.spans.append({"name": name, "before": list(df.columns), "after": list(out.columns), "rows": seen})
            return out.observe(seen, F.count(F.lit(1)).alias("n"))

        return run

    def rows(self) -> dict[str, int]:
        return {s["name"]: s["rows"].get["n"] for s in self.spans}


def with_dead_letters(step: Step, error: Callable[[DataFrame], Column], path: str, source: str = "") -> Step:
    """A step for the good rows; those for which `error` gives a text go to dead letters at `path`."""
    from eventloom.operators.healing import split_errors
    from eventloom.sources.sinks import write_dead_letters

    def run(df: DataFrame) -> DataFrame:
        good, bad = split_errors(df, error(df))
        write_dead_letters(bad, path, source=source)
        return step(good)

    return run
