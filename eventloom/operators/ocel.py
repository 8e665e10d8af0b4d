"""Object-centric event data: events, objects and their relations as six DataFrames."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.session import shares

EVENT = "event_id string, event_type string, timestamp timestamp"
OBJECT = "object_id string, object_type string"
EVENT_OBJECT = "event_id string, object_id string, qualifier string"
OBJECT_OBJECT = "source_id string, target_id string, qualifier string"
EVENT_ATTRIBUTE = "event_id string, attr_name string, attr_value string, attr_type string"
OBJECT_ATTRIBUTE = "object_id string, attr_name string, attr_value string, attr_type string, timestamp timestamp"


@dataclass(frozen=True)
class Ocel:
    """An object-centric log. Object ids are unique over all types."""

    events: DataFrame
    objects: DataFrame
    event_object: DataFrame
    object_object: DataFrame | None = None
    event_attribute: DataFrame | None = None
    object_attribute: DataFrame | None = None

    def add(self, part: str, rows: DataFrame) -> Ocel:
        """The log with more rows in one of its tables."""
        have = getattr(self, part)
        return replace(self, **{part: rows if have is None else have.unionByName(rows)})


def events_of(log: Ocel, object_id: str) -> DataFrame:
    """Events related to an object, in order of time."""
    related = log.event_object.where(F.col("object_id") == object_id).select("event_id").distinct()
    return log.events.join(related, "event_id", "left_semi").orderBy("timestamp", "event_id")


def objects_of(log: Ocel, event_id: str, qualifier: str | None = None) -> DataFrame:
    """Objects related to an event, with a qualifier if one is given."""
    related = log.event_object.where(F.col("event_id") == event_id)
    if qualifier is not None:
        related = related.where(F.col("qualifier") == qualifier)
    return log.objects.join(related.select("object_id").distinct(), "object_id", "left_semi")


def _joined(rows: DataFrame, known: DataFrame, key: str, how: str = "inner", parts: int | None = None) -> DataFrame:
    """`rows` with what is known of their key (an id), in partitions whose number grows with the input, so that a task's share stays small."""
    parts = parts or shares(rows, known)
    return rows.repartition(parts, key).join(known.repartition(parts, key), key, how)


def _joined_by_hash(rows: DataFrame, known: DataFrame, key: str, how: str) -> DataFrame:
    """The same where object ids, which begin alike, are compared: a hash is sorted and compared before them."""
    parts = shares(rows, known)
    known = known.withColumnRenamed(key, "__known")
    a, b = rows.repartition(parts, F.xxhash64(key), key), known.repartition(parts, F.xxhash64("__known"), "__known")
    return a.join(b, (F.xxhash64(key) == F.xxhash64("__known")) & (F.col(key) == F.col("__known")), how).drop("__known")


def events_with_objects(log: Ocel) -> DataFrame:
    """Every relation with its event and object."""
    return log.event_object.join(log.events, "event_id").join(log.objects, "object_id")


def project(log: Ocel, object_type: str) -> DataFrame:
    """The log flattened to one object type: its objects are the cases."""
    wanted = log.objects.where(F.col("object_type") == object_type).select("object_id")
    related = log.event_object.select("event_id", "object_id")
    # where the objects are too many to broadcast, the relations are shuffled like them
    related = related.join(wanted.repartition(shares(related, wanted), "object_id"), "object_id", "left_semi")
    events = log.events.select("event_id", F.col("event_type").alias("activity"), "timestamp")
    return _joined(related, events, "event_id").select(F.col("object_id").alias("case_id"), "event_id", "activity", "timestamp").distinct()


def of_type(log: Ocel, object_type: str) -> DataFrame:
    return log.objects.where(F.col("object_type") == object_type)


def related_objects(log: Ocel, object_id: str) -> DataFrame:
    """Objects one directed step from an object."""
    step = log.object_object.where(F.col("source_id") == object_id).select(F.col("target_id").alias("object_id"), "qualifier")
    return step.join(log.objects, "object_id")


def attributes_at(log: Ocel, at: str) -> DataFrame:
    """object_id, attr_name, attr_value: the version of each attribute at an instant."""
    return log.object_attribute.where(F.col("timestamp") <= F.lit(at).cast("timestamp")).groupBy("object_id", "attr_name").agg(F.max_by("attr_value", F.struct("timestamp", "attr_value")).alias("attr_value"))


def _lifecycles(log: Ocel) -> DataFrame:
    """Events by (object_type, object_id) in order, with the next activity."""
    related = log.event_object.select("event_id", "object_id")
    events = log.events.select("event_id", F.col("event_type").alias("activity"), "timestamp")
    parts = shares(related, events)
    # copies of a row come to stand side by side and are dropped there; types are joined in the same order
    of = F.xxhash64("object_id")
    order = Window.partitionBy("__of", "object_id").orderBy("timestamp", "event_id", "activity")
    one = F.struct("timestamp", "event_id", "activity")
    rows = _joined(related, events, "event_id", parts=parts).repartition(parts, of, "object_id").withColumn("__of", of)
    once = rows.withColumn("__before", F.lag(one).over(order)).where(~F.col("__before").eqNullSafe(one)).drop("__before")
    steps = once.withColumn("next_activity", F.lead("activity").over(order)).withColumn("n", F.row_number().over(order))
    types = log.objects.select("object_id", "object_type").repartition(parts, of, "object_id").withColumn("__of", of).distinct()
    return steps.join(types.hint("merge"), ["__of", "object_id"]).drop("__of")


def oc_dfg(log: Ocel, least: int = 1) -> DataFrame:
    """object_type, activity, next_activity, edge_count of the object-centric directly-follows graph."""
    edges = _lifecycles(log).where("next_activity is not null").groupBy("object_type", "activity", "next_activity").agg(F.count(F.lit(1)).alias("edge_count"))
    return edges.where(F.col("edge_count") >= least)


def oc_activities(log: Ocel) -> DataFrame:
    """object_type, activity, frequency, n_starts, n_ends."""
    return _lifecycles(log).groupBy("object_type", "activity").agg(F.count(F.lit(1)).alias("frequency"), F.count_if(F.col("n") == 1).alias("n_starts"), F.count_if(F.col("next_activity").isNull()).alias("n_ends"))


def shared_activities(log: Ocel) -> DataFrame:
    """Activities of more than one object type."""
    return oc_activities(log).groupBy("activity").agg(F.countDistinct("object_type").alias("n_types")).where("n_types > 1")


def dfg_stats(log: Ocel) -> DataFrame:
    """Edges and their total count by object type."""
    return oc_dfg(log).groupBy("object_type").agg(F.count(F.lit(1)).alias("n_edges"), F.sum("edge_count").alias("n_steps"))


def object_counts(log: Ocel) -> DataFrame:
    return log.objects.groupBy("object_type").agg(F.countDistinct("object_id").alias("n_objects"))


def stats(log: Ocel) -> DataFrame:
    """One row: numbers of events, objects, relations, types and the time range."""
    e = log.events.agg(F.count(F.lit(1)).alias("n_events"), F.countDistinct("event_type").alias("n_event_types"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"))
    o = log.objects.agg(F.count(F.lit(1)).alias("n_objects"), F.countDistinct("object_type").alias("n_object_types"))
    r = log.event_object.agg(F.count(F.lit(1)).alias("n_relations"), F.countDistinct("qualifier").alias("n_qualifiers"))
    one = lambda d: d.withColumn("j", F.lit(1))
    return one(e).join(one(o), "j").join(one(r), "j").drop("j")


def violations(log: Ocel) -> DataFrame:
    """kind, id: relations and attributes whose event or object does not exist."""
    missing = lambda rows, key, known, name, kind: _joined_by_hash(rows.select(F.col(key).alias("id")), known.select(F.col(name).alias("id")), "id", "left_anti").distinct().select(F.lit(kind).alias("kind"), "id")
    out = missing(log.event_object, "event_id", log.events, "event_id", "relation without event").unionByName(missing(log.event_object, "object_id", log.objects, "object_id", "relation without object"))
    if log.object_object is not None:
        for end in ("source_id", "target_id"):
            out = out.unionByName(missing(log.object_object, end, log.objects, "object_id", f"object relation without {end.removesuffix('_id')}"))
    if log.event_attribute is not None:
        out = out.unionByName(missing(log.event_attribute, "event_id", log.events, "event_id", "attribute without event"))
    if log.object_attribute is not None:
        out = out.unionByName(missing(log.object_attribute, "object_id", log.objects, "object_id", "attribute without object"))
    return out


def object_columns(columns: list[str]) -> tuple[dict[str, str], list[str]]:
    """(id column -> object type, type columns) that names hint at: *_id but not of cases and events, *_type but not of events and attributes."""
    ids = {c: c[:-3] for c in columns if c.lower().endswith("_id") and c.lower() not in ("case_id", "event_id")}
    return ids, [c for c in columns if c.lower().endswith("_type") and c.lower() not in ("event_type", "attr_type", "attribute_type")]


def with_objects(df: DataFrame, ids: dict[str, str] | None = None, name: str = "ocel_objects") -> DataFrame:
    """The frame with a nested column of (object_id, object_type) from its id columns; null and empty ids are left out."""
    ids = object_columns(df.columns)[0] if ids is None else ids
    entries = [F.struct(F.col(c).cast("string").alias("object_id"), F.lit(t).alias("object_type")) for c, t in ids.items()]
    made = F.filter(F.array(*entries), lambda o: o["object_id"].isNotNull() & (o["object_id"] != "")) if entries else F.array().cast("array<struct<object_id: string, object_type: string>>")
    return df.withColumn(name, made)


def unnested(df: DataFrame, name: str = "ocel_objects", outer: bool = False) -> DataFrame:
    """A row per event and object of it; events without objects only if `outer`."""
    explode = F.explode_outer if outer else F.explode
    return df.select(*[c for c in df.columns if c != name], explode(name).alias("__o")).select("*", "__o.object_id", "__o.object_type").drop("__o")


def nested_dfg(df: DataFrame, activity: str, time: str, order: str, name: str = "ocel_objects") -> DataFrame:
    """The directly-follows edges by object type of a frame with nested objects."""
    w = Window.partitionBy("object_type", "object_id").orderBy(time, order)
    steps = unnested(df, name).select("object_type", F.col(activity).alias("activity"), F.lead(activity).over(w).alias("next_activity"))
    return steps.where("next_activity is not null").groupBy("object_type", "activity", "next_activity").agg(F.count(F.lit(1)).alias("edge_count"))


def to_text(value: Column, kind: str) -> Column:
    """An attribute value as text: floats keep all digits, times are ISO 8601 with microseconds."""
    return F.date_format(value.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'") if kind == "time" else value.cast("string")


def from_text(value: Column, kind: str) -> Column:
    types = {"int": "bigint", "float": "double", "bool": "boolean", "time": "timestamp", "string": "string"}
    return value.try_cast(types[kind])


def write(log: Ocel, folder: str) -> None:
    """A Parquet folder per table."""
    for f in fields(log):
        if (df := getattr(log, f.name)) is not None:
            df.write.mode("overwrite").parquet(f"{folder}/{f.name}")


def read(spark: SparkSession, folder: str, parts: tuple[str, ...] = ("events", "objects", "event_object")) -> Ocel:
    return Ocel(**{p: spark.read.parquet(f"{folder}/{p}") for p in parts})


def write_json(log: Ocel, path: str) -> None:
    """Events (with the ids and qualifiers of their objects) and objects as gzipped JSON lines, one folder each, in as many files as their size asks for."""
    parts = shares(log.event_object, log.events)
    related = log.event_object.repartition(parts, "event_id").groupBy("event_id").agg(F.sort_array(F.collect_list(F.struct("object_id", "qualifier"))).alias("relationships"))
    log.events.repartition(parts, "event_id").join(related, "event_id", "left").write.mode("overwrite").option("compression", "gzip").json(f"{path}/events")
    log.objects.write.mode("overwrite").option("compression", "gzip").json(f"{path}/objects")


def read_json(spark: SparkSession, path: str) -> Ocel:
    """What :func:`write_json` wrote."""
    raw = spark.read.schema(f"{EVENT}, relationships array<struct<object_id: string, qualifier: string>>").json(f"{path}/events")
    relations = raw.select("event_id", F.explode("relationships").alias("r")).select("event_id", "r.object_id", "r.qualifier")
    return Ocel(raw.drop("relationships"), spark.read.schema(OBJECT).json(f"{path}/objects"), relations)


def from_document(spark: SparkSession, text: str) -> Ocel:
    """A single OCEL 2.0 JSON document (small: held on the driver)."""
    doc = json.loads(text)
    events = [(e["id"], e["type"], e["time"]) for e in doc.get("events", [])]
    e2o = [(e["id"], r["objectId"], r.get("qualifier")) for e in doc.get("events", []) for r in e.get("relationships", [])]
    objects = [(o["id"], o["type"]) for o in doc.get("objects", [])]
    o2o = [(o["id"], r["objectId"], r.get("qualifier")) for o in doc.get("objects", []) for r in o.get("relationships", [])]
    attributes = [(o["id"], a["name"], str(a["value"]), "string", a.get("time")) for o in doc.get("objects", []) for a in o.get("attributes", [])]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    timed = lambda df: df.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    return Ocel(
        timed(frame(events, "event_id string, event_type string, timestamp string")),
        frame(objects, OBJECT),
        frame(e2o, EVENT_OBJECT),
        frame(o2o, OBJECT_OBJECT),
        None,
        timed(frame(attributes, "object_id string, attr_name string, attr_value string, attr_type string, timestamp string")),
    )
