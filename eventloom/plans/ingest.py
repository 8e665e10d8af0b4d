"""Ingest: files of any format to Parquet by presets, in batches of small files, with progress that a later run goes on from."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.plans.pipeline import PRESETS
from eventloom.sources import readers, sinks, stores


@dataclass(frozen=True)
class Preset:
    """How a table is read and written: `typed` finds types by a vote over all values, `codec` and `rows_per_file` are the writer's, `settings` the session's."""

    typed: bool
    codec: str
    rows_per_file: int
    settings: dict[str, str]


INGEST = {
    "high_speed": Preset(False, "snappy", 10_000_000, PRESETS["high_speed"]),
    "high_quality": Preset(True, "zstd", 1_000_000, PRESETS["high_quality"]),
    "low_memory": Preset(False, "zstd", 100_000, PRESETS["low_memory"]),
}


def ingest(spark: SparkSession, paths: str | list[str], to: str, preset: str = "high_quality", kind: str = "csv") -> DataFrame:
    """Files as a Parquet table at `to`, appended; returns what was written, read back. Session settings are as before afterwards."""
    how = INGEST[preset]
    before = {k: spark.conf.get(k, None) for k in how.settings}
    try:
        for k, v in how.settings.items():
            spark.conf.set(k, v)
        df = readers.typed_csv(spark, paths) if how.typed and kind == "csv" else readers.READERS[kind](spark, paths)
        df.write.mode("append").option("compression", sinks.codec(how.codec)).option("maxRecordsPerFile", how.rows_per_file).parquet(to)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.parquet(to)


def batches(files: Iterable[stores.Stored], target: int = 128 << 20, most: int = 1000) -> list[list[str]]:
    """Small files put together in the order of their paths: about `target` bytes and at most `most` files a batch."""
    out: list[list[str]] = []
    held = 0
    for x in sorted(files, key=lambda x: x.path):
        if not out or held + x.size > target or len(out[-1]) >= most:
            out.append([])
            held = 0
        out[-1].append(x.path)
        held += x.size
    return out


@dataclass
class Progress:
    """What an ingest has done, kept as JSON in the shared folder: files that are in, and rows and bytes of them."""

    path: str
    done: list[str] = field(default_factory=list)
    rows: int = 0
    bytes: int = 0

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Progress:
        return cls(**json.loads(b"".join(stores.get(spark, path)))) if stores.exists(spark, path) else cls(path)

    @property
    def started(self) -> bool:
        return bool(self.done)

    def left(self, files: Iterable[stores.Stored]) -> list[stores.Stored]:
        have = set(self.done)
        return [x for x in files if x.path not in have]

    def add(self, spark: SparkSession, paths: list[str], rows: int, size: int) -> None:
        self.done, self.rows, self.bytes = [*self.done, *paths], self.rows + rows, self.bytes + size
        stores.put(spark, self.path, json.dumps(asdict(self)).encode())


def ingest_folder(spark: SparkSession, folder: str, to: str, progress: str, preset: str = "high_speed", kind: str = "csv", target: int = 128 << 20, pace: Callable[[int], None] | None = None, most_batches: int | None = None) -> Progress:
    """A folder's files in batches, each a folder of its own below `to` that is written whole or again: a run that was cut short goes on with the first batch that is not in. `pace` is told each batch's bytes and may wait."""
    state = Progress.load(spark, progress)
    found = {x.path: x for x in state.left(stores.listed(spark, folder)) if not x.path.rsplit("/", 1)[-1].startswith(("_", "."))}
    for paths in batches(found.values(), target)[:most_batches]:
        size = sum(found[p].size for p in paths)
        if pace:
            pace(size)
        part = f"{to}/batch={len(state.done)}"
        stores.delete(spark, part)
        rows = ingest(spark, paths, part, preset, kind).count()
        state.add(spark, paths, rows, size)
    return state


class Pace:
    """A token bucket: so many bytes a second on average, `burst` at once."""

    def __init__(self, per_second: float, burst: float, clock: Callable[[], float] | None = None, wait: Callable[[float], None] | None = None):
        import time

        self.per_second, self.burst, self.clock, self.wait = per_second, burst, clock or time.monotonic, wait or time.sleep
        self.tokens, self.at = burst, self.clock()

    def __call__(self, amount: float) -> None:
        now = self.clock()
        self.tokens = min(self.burst, self.tokens + (now - self.at) * self.per_second)
        self.at = now
        self.tokens -= amount
        if self.tokens < 0:
            self.wait(-self.tokens / self.per_second)


def watch(spark: SparkSession, folder: str, rebuild: Callable[[list[stores.Stored]], None], quiet: float = 0.5, poll: float = 0.1, stop: Callable[[], bool] = lambda: False) -> int:
    """Calls `rebuild` with all files of a folder whenever they have changed and then stayed the same for `quiet` seconds; returns how often, once `stop` says so."""
    import time

    look = lambda: {x.path: (x.size, x.changed) for x in stores.listed(spark, folder)}
    built: dict | None = None
    seen, since, times = look(), time.monotonic(), 0
    while not stop():
        now = look()
        if now != seen:
            seen, since = now, time.monotonic()
        elif seen != built and time.monotonic() - since >= quiet:
            rebuild([stores.Stored(p, *v) for p, v in sorted(seen.items())])
            built, times = seen, times + 1
        time.sleep(poll)
    return times


def throughput(df: DataFrame, seconds: float) -> dict[str, float]:
    """Rows, and rows a second."""
    n = df.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    return {"rows": n, "rows_per_second": n / seconds if seconds else 0.0}
