"""Objects in any store that Spark's file systems reach (s3a://, gs://, hdfs://, file://): put, get, ranges, lists, checks.

Paths are Hadoop paths; credentials are Hadoop settings. Objects are streamed in parts of PART
bytes, so none is held whole on the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

PART = 1 << 20


@dataclass(frozen=True)
class Stored:
    """An object: path, bytes, time of change (milliseconds since 1970)."""

    path: str
    size: int
    changed: int


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def put(spark: SparkSession, path: str, data: bytes | Iterable[bytes]) -> str:
    """Writes an object in parts; a store with multipart uploads gets one."""
    system, where = _at(spark, path)
    out = system.create(where, True)
    try:
        for part in [data] if isinstance(data, bytes) else data:
            out.write(bytearray(part))
    finally:
        out.close()
    return path


def get(spark: SparkSession, path: str, start: int = 0, length: int | None = None) -> Iterator[bytes]:
    """An object, or `length` bytes of it from `start` on, in parts."""
    system, where = _at(spark, path)
    left = system.getFileStatus(where).getLen() - start if length is None else length
    io = spark.sparkContext._jvm.org.apache.commons.io.IOUtils
    source = system.open(where)
    try:
        source.seek(start)
        while left > 0:
            part = bytes(io.toByteArray(spark.sparkContext._jvm.org.apache.commons.io.input.BoundedInputStream(source, min(PART, left))))
            if not part:
                return
            left -= len(part)
            yield part
    finally:
        source.close()


def read_range(spark: SparkSession, path: str, start: int, length: int) -> bytes:
    return b"".join(get(spark, path, start, length))


def listed(spark: SparkSession, folder: str, prefix: str = "", recursive: bool = True) -> Iterator[Stored]:
    """The objects below a folder whose names start with `prefix`, as the store lists them."""
    system, where = _at(spark, folder)
    files = system.listFiles(where, recursive)
    while files.hasNext():
        status = files.next()
        if status.getPath().getName().startswith(prefix):
            yield Stored(status.getPath().toString(), status.getLen(), status.getModificationTime())


def listing(spark: SparkSession, folder: str, prefix: str = "", recursive: bool = True) -> DataFrame:
    """path, size, changed of the objects below a folder."""
    return spark.createDataFrame([(x.path, x.size, x.changed) for x in listed(spark, folder, prefix, recursive)], "path string, size long, changed long")


def exists(spark: SparkSession, path: str) -> bool:
    system, where = _at(spark, path)
    return system.exists(where)


def delete(spark: SparkSession, path: str) -> bool:
    """Deletes an object or folder; False if there was none."""
    system, where = _at(spark, path)
    return system.delete(where, True)


#: The first and last bytes of a Parquet file (plain, and with an encrypted footer).
PARQUET_MARKS = (b"PAR1", b"PARE")


def parquet_problem(spark: SparkSession, path: str) -> str | None:
    """What is wrong with a Parquet file by its marks and the length of its footer; None for a sound one."""
    if not exists(spark, path):
        return "no such file"
    system, where = _at(spark, path)
    size = system.getFileStatus(where).getLen()
    if size < 12:
        return "too small"
    if read_range(spark, path, 0, 4) not in PARQUET_MARKS:
        return "no mark at the start"
    tail = read_range(spark, path, size - 8, 8)
    if tail[4:] not in PARQUET_MARKS:
        return "no mark at the end"
    footer = int.from_bytes(tail[:4], "little")
    return None if 0 < footer <= size - 12 else "footer longer than the file"
