"""Readers of logs and tables, by format."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.log import event_log
from eventloom.operators import schemas
from eventloom.sources import stores

ROW_ERROR = "_corrupt_record"


def csv(spark: SparkSession, path: str | list[str], sep: str = ",", schema: T.StructType | str | None = None, infer: bool = True, encoding: str = "UTF-8") -> DataFrame:
    """Delimited text with a header; gzip by extension."""
    reader = spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').option("encoding", encoding)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", infer).option("samplingRatio", 1.0).csv(path)


def typed_csv(spark: SparkSession, path: str | list[str], sep: str = ",", multiline: bool = True) -> DataFrame:
    """Delimited text as strings, typed by vote over all values: null tokens and values that do not fit are null."""
    raw = spark.read.option("header", True).option("sep", sep).option("escape", '"').option("multiLine", multiline).option("mode", "PERMISSIVE").csv(path)
    return schemas.typed(raw, schemas.inferred(raw))


def robust_csv(spark: SparkSession, path: str, columns: list[str], sep: str = ",") -> DataFrame:
    """Rows of text split at the delimiter outside quotes: short rows padded with nulls, long ones cut, `_fields` holds how many there were."""
    from eventloom.operators import healing

    lines = spark.read.text(path).where("value <> ''").select(F.make_valid_utf8(F.col("value")).alias("value"))
    healed = healing.heal("value", sep, rules=("encoding", "nul", "newlines", "quotes"))
    pattern = f'{"[" + sep + "]" if sep != "|" else "[|]"}(?=(?:[^"]*"[^"]*")*[^"]*$)'
    parts = F.transform(F.split(healed, pattern), lambda x: F.replace(F.regexp_replace(F.trim(x), r'^"(.*)"$', "$1"), F.lit('""'), F.lit('"')))
    rows = lines.select(parts.alias("p")).where(F.array_join("p", "\x01") != "\x01".join(columns))
    return rows.select(*[F.get("p", F.lit(i)).alias(c) for i, c in enumerate(columns)], F.size("p").alias("_fields"))


def event_csv(spark: SparkSession, path: str, case_id: str, activity: str, timestamp: str, resource: str | None = None, sep: str = ",", on_error: str = "skip") -> DataFrame:
    """A log from delimited text with named roles. Rows without a time that parses are bad: dropped (skip), kept with `error` (quarantine) or a failure (strict). Other columns become the map `attributes`."""
    raw = csv(spark, path, sep, infer=False)
    if gone := [c for c in (case_id, activity, timestamp) if c not in raw.columns]:
        raise ValueError(f"columns missing: {gone}")
    others = [c for c in raw.columns if c not in (case_id, activity, timestamp, resource)]
    time = parse_time(F.col(timestamp))
    attributes = F.map_from_arrays(F.array(*[F.lit(c) for c in others]), F.array(*[F.col(c) for c in others])) if others else F.create_map().cast("map<string,string>")
    rows = raw.select(
        F.col(case_id).alias("case_id"),
        F.col(activity).alias("activity"),
        (F.unix_micros(time) * 1000).alias("timestamp"),
        (F.col(resource) if resource and resource in raw.columns else F.lit(None).cast("string")).alias("resource"),
        F.map_filter(attributes, lambda k, v: v.isNotNull()).alias("attributes"),
        F.when(time.isNull(), F.concat(F.lit("not a time: "), F.coalesce(F.col(timestamp), F.lit("null")))).alias("error"),
    )
    if on_error == "quarantine":
        return rows
    if on_error == "strict":
        return rows.where(F.when(F.col("error").isNotNull(), F.raise_error("error").isNull()).otherwise(F.lit(True))).drop("error")
    return rows.where("error is null").drop("error")


#: Layouts of times, in the order in which they are tried.
LAYOUTS = (
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]", "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]", "yyyy-MM-dd HH:mm", "yyyy-MM-dd",
    "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy", "dd-MMM-yyyy HH:mm:ss", "dd.MM.yyyy HH:mm:ss",
)


def parse_time(c: Column, layouts: tuple[str, ...] = LAYOUTS) -> Column:
    """A time from text in any of the layouts, or a spreadsheet's day number; null if none fits."""
    c = F.trim(c)
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(x)) for x in layouts], excel_time(c.try_cast("double")))


def excel_time(days: Column) -> Column:
    """Day number 1 is 1900-01-01; from 60 on one day less, as the spreadsheet counts a 29 February 1900. Numbers outside 1 .. 2958466 are no days."""
    real = F.when(days < 60, days + 1).otherwise(days)
    return F.when((days >= 1) & (days < 2958466), F.timestamp_micros(F.round((real - 25569) * 86400 * 1000).cast("long") * 1000))


def json(spark: SparkSession, path: str, schema: T.StructType | str | None = None, lines: bool = True, as_text: bool = False, mode: str = "PERMISSIVE") -> DataFrame:
    """JSON lines or documents; `mode` drops, keeps or fails on malformed ones."""
    reader = spark.read.option("multiLine", not lines).option("primitivesAsString", as_text).option("mode", mode)
    return (reader.schema(schema) if schema else reader).json(path)


def json_text(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of objects, or a single one, with every member as text: strings as they are, nested values as JSON, null as null. The columns are all members that occur, by name."""
    whole = spark.read.text(path, wholetext=True).select(F.when(F.trim("value").startswith("["), F.col("value")).otherwise(F.concat(F.lit("["), "value", F.lit("]"))).alias("value"))
    rows = whole.select(F.explode(F.from_json("value", "array<map<string,string>>")).alias("m"))
    names = sorted(r[0] for r in rows.select(F.explode(F.map_keys("m")).alias("k")).distinct().collect())  # a row a column
    return rows.select(*[F.col("m")[n].alias(n) for n in names])


def event_json(spark: SparkSession, path: str, case_id: str, activity: str, timestamp: str, resource: str | None = None) -> DataFrame:
    """A log from JSON lines; other members become the map `attributes`."""
    raw = spark.read.text(path).select(F.from_json("value", "map<string,string>").alias("m")).where("m is not null")
    roles = [x for x in (case_id, activity, timestamp, resource) if x]
    time = parse_time(F.col("m")[timestamp])
    return raw.select(
        F.col("m")[case_id].alias("case_id"),
        F.col("m")[activity].alias("activity"),
        (F.unix_micros(time) * 1000).alias("timestamp"),
        (F.col("m")[resource] if resource else F.lit(None).cast("string")).alias("resource"),
        F.map_filter("m", lambda k, v: ~k.isin(roles)).alias("attributes"),
    ).where("timestamp is not null")


def parquet(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.parquet(*([path] if isinstance(path, str) else path))


_KEYED = T.ArrayType(T.StructType([T.StructField("_key", T.StringType()), T.StructField("_value", T.StringType())]))
_KINDS = ("string", "date", "int", "float", "boolean", "id")
_EVENT = T.StructType([T.StructField(k, _KEYED) for k in _KINDS])
_TRACE = T.StructType([*(T.StructField(k, _KEYED) for k in _KINDS), T.StructField("event", T.ArrayType(_EVENT))])


def xes(spark: SparkSession, path: str) -> DataFrame:
    """An XES log: case_id, activity, timestamp (ns), resource, lifecycle, seq (place in the trace), trace and event attributes as maps of text."""
    traces = spark.read.format("xml").option("rowTag", "trace").schema(_TRACE).load(path)
    return traces.select(_attributes("").alias("trace"), F.posexplode("event").alias("seq", "e")).select(F.col("trace"), F.col("seq").cast("long"), _attributes("e.").alias("attributes")).select(
        F.col("trace")["concept:name"].alias("case_id"),
        F.col("attributes")["concept:name"].alias("activity"),
        (F.unix_micros(F.col("attributes")["time:timestamp"].try_cast("timestamp")) * 1000).alias("timestamp"),
        F.col("attributes")["org:resource"].alias("resource"),
        F.col("attributes")["lifecycle:transition"].alias("lifecycle"),
        "seq",
        "trace",
        "attributes",
    )


def typed_xes(spark: SparkSession, path: str) -> DataFrame:
    """An XES log's events: case_id, activity, timestamp (ns), resource, seq, and attributes with their types: an array of (key, type, value)."""
    traces = spark.read.format("xml").option("rowTag", "trace").schema(_TRACE).load(path)
    events = traces.select(_attributes("").alias("trace"), F.posexplode("event").alias("seq", "e"))
    of_kind = lambda k: F.transform(F.coalesce(F.col(f"e.{k}"), F.array().cast(_KEYED)), lambda x: F.struct(x["_key"].alias("key"), F.lit(k).alias("type"), x["_value"].alias("value")))
    typed = F.flatten(F.array(*[of_kind(k) for k in _KINDS]))
    roles = ("concept:name", "time:timestamp", "org:resource")
    return events.select("trace", F.col("seq").cast("long").alias("seq"), _attributes("e.").alias("a"), F.filter(typed, lambda x: ~x["key"].isin(*roles)).alias("attributes")).select(
        F.col("trace")["concept:name"].alias("case_id"),
        F.col("a")["concept:name"].alias("activity"),
        (F.unix_micros(F.col("a")["time:timestamp"].try_cast("timestamp")) * 1000).alias("timestamp"),
        F.col("a")["org:resource"].alias("resource"),
        "seq",
        "attributes",
    )


def _attributes(of: str) -> Column:
    every = F.flatten(F.array(*[F.coalesce(F.col(f"{of}{k}"), F.array().cast(_KEYED)) for k in _KINDS]))
    return F.map_from_entries(F.transform(F.array_distinct(F.transform(every, lambda x: x["_key"])), lambda k: F.struct(k.alias("key"), F.get(F.filter(every, lambda x: x["_key"] == k), F.lit(0))["_value"].alias("value"))))


ACCESS_LINE = r'^(\S+) (\S+) (\S+) \[([^\]]+)\] "([^"]*)" (\d{3}) (\S+)(?: "([^"]*)" "([^"]*)")?'


def access_log(spark: SparkSession, path: str) -> DataFrame:
    """A web server's log (common or combined): case and resource are the address, the activity is the path."""
    line = lambda k: F.nullif(F.regexp_extract("value", ACCESS_LINE, k), F.lit(""))
    time = F.try_to_timestamp(line(4), F.lit("dd/MMM/yyyy:HH:mm:ss Z"))
    return (
        spark.read.text(path)
        .where(F.col("value").rlike(ACCESS_LINE))
        .select(
            line(1).alias("case_id"),
            request_path(line(5)).alias("activity"),
            (F.unix_micros(time) * 1000).alias("timestamp"),
            line(1).alias("resource"),
            line(6).cast("int").alias("status"),
            line(7).try_cast("long").alias("bytes"),
            line(8).alias("referer"),
            line(9).alias("agent"),
        )
    )


def request_path(request: Column) -> Column:
    """The path of a request line, without its query."""
    return F.regexp_extract(request, r"^\S+ ([^? ]*)", 1)


def xlsx(spark: SparkSession, path: str, case_id: str | None = None, activity: str | None = None, timestamp: str | None = None) -> DataFrame:
    """The first sheet of a workbook (by the names in its first row) as text; as a log if roles are named. Parsed by one task, as a workbook is one compressed file."""
    from eventloom.sources.workbook import rows

    def parse(batches):
        for pdf in batches:
            for content in pdf["content"]:
                import pandas as pd

                found = list(rows(bytes(content)))
                yield pd.DataFrame({"cells": found}) if found else pd.DataFrame({"cells": pd.Series([], dtype=object)})

    sheet = spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, "cells array<string>")
    numbered = sheet.withColumn("at", F.monotonically_increasing_id())
    names = numbered.orderBy("at").limit(1).first()
    columns = [c or f"column_{i}" for i, c in enumerate(names["cells"])] if names else []
    table = numbered.where(F.col("at") != (names["at"] if names else -1)).select("at", *[F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(columns)])
    if not timestamp:
        return table.drop("at")
    return event_log(table.withColumn(timestamp, parse_time(F.col(timestamp))), case_id, activity, timestamp, seq="at")


def memory(spark: SparkSession, data: str | bytes, kind: str = "csv", **options) -> DataFrame:
    """A small text held on the driver."""
    lines = spark.createDataFrame([(x,) for x in (data.decode() if isinstance(data, bytes) else data).splitlines() if x], "value string").rdd.map(lambda r: r[0])
    return spark.read.json(lines) if kind == "jsonl" else spark.read.option("header", True).option("inferSchema", True).csv(lines, **options)


#: Content types and the formats that they announce.
CONTENT_TYPES = {
    "text/csv": "csv", "application/csv": "csv", "text/tab-separated-values": "tsv", "application/json": "json", "application/x-ndjson": "jsonl", "application/jsonl": "jsonl",
    "application/xml": "xes", "text/xml": "xes", "application/vnd.apache.parquet": "parquet", "application/x-parquet": "parquet",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx",
}


def download(spark: SparkSession, url: str, folder: str, headers: dict[str, str] | None = None, user: str | None = None, password: str = "") -> tuple[str, str | None]:
    """A file from the web, written to the shared folder through Spark's own file system: its path, and the format that the content type or else the extension names.

    With `user` the request carries basic authentication.
    """
    from base64 import b64encode
    from urllib.parse import urlsplit
    from urllib.request import Request, urlopen

    headers = dict(headers or {})
    if user is not None:
        headers["Authorization"] = "Basic " + b64encode(f"{user}:{password}".encode()).decode()
    name = urlsplit(url).path.rstrip("/").rsplit("/", 1)[-1] or "download"
    with urlopen(Request(url, headers=headers)) as response:
        kind = CONTENT_TYPES.get((response.headers.get_content_type() or "").lower())
        path = stores.put(spark, f"{folder}/{name}", iter(lambda: response.read(stores.PART), b""))
    extension = name.removesuffix(".gz").rsplit(".", 1)[-1].lower()
    return path, kind or (extension if extension in READERS else None)


def http(spark: SparkSession, url: str, folder: str, kind: str | None = None, headers: dict[str, str] | None = None, user: str | None = None, password: str = "", **options) -> DataFrame:
    """A table from the web: downloaded, then read by its format (`kind`, or what the server says, or the extension)."""
    path, found = download(spark, url, folder, headers, user, password)
    return read(spark, path, kind or found, **options)


def union_csv(spark: SparkSession, paths: list[str], sep: str = ",") -> DataFrame:
    """Several files by the names of their columns; a column that a file lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [csv(spark, p, sep) for p in paths])


def files(spark: SparkSession, glob: str) -> DataFrame:
    """path, length and time of change of the files that a pattern names."""
    return spark.read.format("binaryFile").load(glob).select("path", "length", "modificationTime")


READERS: dict[str, Callable[..., DataFrame]] = {"csv": csv, "tsv": lambda s, p, **k: csv(s, p, sep="\t", **k), "json": lambda s, p, **k: json(s, p, lines=False, **k), "jsonl": json, "parquet": parquet, "xes": xes, "xlsx": xlsx, "accesslog": access_log, "orc": lambda s, p: s.read.orc(p)}


def register(name: str, reader: Callable[..., DataFrame]) -> None:
    READERS[name] = reader


def read(spark: SparkSession, path: str, kind: str | None = None, **options) -> DataFrame:
    """A file by its format, or that of its extension (before .gz)."""
    name = path.rstrip("/").removesuffix(".gz").rsplit(".", 1)[-1].lower()
    kind = kind or {"ndjson": "jsonl", "log": "accesslog", "txt": "csv"}.get(name, name)
    if kind not in READERS:
        raise ValueError(f"no reader for {kind!r}: {sorted(READERS)}")
    return READERS[kind](spark, path, **options)
