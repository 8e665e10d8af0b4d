"""Queries over the object-centric log of orders and items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.operators import intervals
from eventloom.operators import ocel as oc
from eventloom.plans.registry import O, ocel, query
from eventloom.session import scratch, table

query("jn01_events_of_object", O + " SELECT DISTINCT ev.* FROM ev JOIN eo USING (event_id) WHERE object_id = 'order:7'")(lambda s, d: oc.events_of(ocel(s, d), "order:7").distinct())
query("jn02_objects_of_event", O + " SELECT DISTINCT ob.* FROM ob JOIN eo USING (object_id) WHERE event_id = 'o7'")(lambda s, d: oc.objects_of(ocel(s, d), "o7"))
query("jn04_objects_by_qualifier", O + " SELECT DISTINCT ob.* FROM ob JOIN eo USING (object_id) WHERE event_id = 'o7' AND qualifier = 'by'")(lambda s, d: oc.objects_of(ocel(s, d), "o7", "by"))
query("jn03_events_with_objects", O + " SELECT object_type, event_type, qualifier, count(*) AS n FROM eo JOIN ev USING (event_id) JOIN ob USING (object_id) GROUP BY 1, 2, 3")(
    lambda s, d: oc.events_with_objects(ocel(s, d)).groupBy("object_type", "event_type", "qualifier").agg(F.count(F.lit(1)).alias("n"))
)
query("oc01_object_columns", "SELECT * FROM (VALUES ('customer_id', 'customer'), ('order_id', 'order')) t(column_name, object_type)")(
    lambda s, d: s.createDataFrame(list(oc.object_columns(["case_id", "event_id", "customer_id", "order_id", "event_type", "item_type", "amount"])[0].items()), "column_name string, object_type string")
)

NESTED = "WITH n AS (SELECT o_orderkey, o_orderdate, o_orderstatus, list_filter([{'object_id': CAST(o_orderkey AS VARCHAR), 'object_type': 'order'}, {'object_id': CASE WHEN o_custkey % 5 <> 0 THEN CAST(o_custkey AS VARCHAR) END, 'object_type': 'customer'}], lambda x: x.object_id IS NOT NULL) AS objs FROM orders), u AS (SELECT o_orderkey, o_orderdate, o_orderstatus, unnest(objs) AS o FROM n)"


def nested(s, d) -> DataFrame:
    orders = table(s, d, "orders").withColumn("customer", F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey")))
    return oc.with_objects(orders, {"o_orderkey": "order", "customer": "customer"})


query("oc02_with_objects", NESTED + " SELECT o_orderkey, len(objs) AS n_objects FROM n")(lambda s, d: nested(s, d).select("o_orderkey", F.size("ocel_objects").cast("long").alias("n_objects")))
query("oc03_unnested", NESTED + " SELECT o_orderkey, o.object_id AS object_id, o.object_type AS object_type FROM u")(lambda s, d: oc.unnested(nested(s, d)).select("o_orderkey", "object_id", "object_type"))
query("oc03_by_type", NESTED + " SELECT o_orderkey, o.object_id AS object_id FROM u WHERE o.object_type = 'customer'")(lambda s, d: oc.unnested(nested(s, d)).where("object_type = 'customer'").select("o_orderkey", "object_id"))
query("oc03_by_id", NESTED + " SELECT o_orderkey FROM u WHERE o.object_id = '7'")(lambda s, d: oc.unnested(nested(s, d)).where("object_id = '7'").select("o_orderkey"))
query("jn06_unnest_inner", NESTED + " SELECT o.object_type AS object_type, count(*) AS n FROM u GROUP BY 1")(lambda s, d: oc.unnested(nested(s, d)).groupBy("object_type").agg(F.count(F.lit(1)).alias("n")))
query("ag11_objects_by_type", NESTED + " SELECT o.object_type AS object_type, count(DISTINCT o.object_id) AS n_objects FROM u GROUP BY 1")(lambda s, d: oc.unnested(nested(s, d)).groupBy("object_type").agg(F.countDistinct("object_id").alias("n_objects")))
query("ag12_object_types", NESTED + " SELECT DISTINCT o.object_type AS object_type FROM u")(lambda s, d: oc.unnested(nested(s, d)).select("object_type").distinct())
query("oc05_nested_dfg", NESTED + ", f AS (SELECT o.object_type AS object_type, o_orderstatus AS activity, lead(o_orderstatus) OVER (PARTITION BY o.object_type, o.object_id ORDER BY o_orderdate, o_orderkey) AS next_activity FROM u) SELECT object_type, activity, next_activity, count(*) AS edge_count FROM f WHERE next_activity IS NOT NULL GROUP BY 1, 2, 3")(
    lambda s, d: oc.nested_dfg(nested(s, d), "o_orderstatus", "o_orderdate", "o_orderkey")
)
query("oc04_object_counts", O + " SELECT object_type, count(DISTINCT object_id) AS n_objects FROM ob GROUP BY 1")(lambda s, d: oc.object_counts(ocel(s, d)))
query("ag10_oc_dfg", O + " SELECT object_type, activity, next_activity, count(*) AS edge_count FROM flow WHERE next_activity IS NOT NULL GROUP BY 1, 2, 3")(lambda s, d: oc.oc_dfg(ocel(s, d)))
query("oc05_activities", O + " SELECT object_type, activity, count(*) AS frequency, count(*) FILTER (n = 1) AS n_starts, count(*) FILTER (next_activity IS NULL) AS n_ends FROM flow GROUP BY 1, 2")(lambda s, d: oc.oc_activities(ocel(s, d)))
query("ag28_shared_activities", O + " SELECT activity, count(DISTINCT object_type) AS n_types FROM flow GROUP BY 1 HAVING n_types > 1")(lambda s, d: oc.shared_activities(ocel(s, d)))
query("ag29_dfg_stats", O + ", x AS (SELECT object_type, activity, next_activity, count(*) AS c FROM flow WHERE next_activity IS NOT NULL GROUP BY 1, 2, 3) SELECT object_type, count(*) AS n_edges, CAST(sum(c) AS BIGINT) AS n_steps FROM x GROUP BY 1")(lambda s, d: oc.dfg_stats(ocel(s, d)))
query("oc06_projection", O + " SELECT case_id, count(*) AS n, min(activity) AS first_activity FROM (SELECT DISTINCT object_id AS case_id, event_id, event_type AS activity, timestamp FROM eo JOIN ev USING (event_id) JOIN ob USING (object_id) WHERE object_type = 'customer') t GROUP BY 1")(
    lambda s, d: oc.project(ocel(s, d), "customer").groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.min("activity").alias("first_activity"))
)
query("oc07_objects_of_type", O + " SELECT * FROM ob WHERE object_type = 'supplier'")(lambda s, d: oc.of_type(ocel(s, d), "supplier"))
query("oc07_event", O + " SELECT * FROM ev WHERE event_id = 'o11'")(lambda s, d: ocel(s, d).events.where("event_id = 'o11'"))
query("oc08_related_objects", O + " SELECT target_id AS object_id, qualifier, object_type FROM oo JOIN ob ON target_id = object_id WHERE source_id = 'customer:7'")(lambda s, d: oc.related_objects(ocel(s, d), "customer:7").select("object_id", "qualifier", "object_type"))
query("ag22_log_stats", O + " SELECT (SELECT count(*) FROM ev) AS n_events, (SELECT count(DISTINCT event_type) FROM ev) AS n_event_types, (SELECT min(timestamp) FROM ev) AS first_ts, (SELECT max(timestamp) FROM ev) AS last_ts, (SELECT count(*) FROM ob) AS n_objects, (SELECT count(DISTINCT object_type) FROM ob) AS n_object_types, (SELECT count(*) FROM eo) AS n_relations, (SELECT count(DISTINCT qualifier) FROM eo) AS n_qualifiers")(
    lambda s, d: oc.stats(ocel(s, d))
)
query("oc14_qualifiers", O + " SELECT qualifier, count(*) AS n FROM eo GROUP BY 1")(lambda s, d: ocel(s, d).event_object.groupBy("qualifier").agg(F.count(F.lit(1)).alias("n")))


def broken(s, d) -> oc.Ocel:
    """The log without a twentieth of its orders as objects."""
    log = ocel(s, d)
    return oc.Ocel(log.events, log.objects.where("not (object_type = 'order' and cast(substring(object_id, 7) as long) % 20 = 0)"), log.event_object, log.object_object)


B = O + ", known AS (SELECT * FROM ob WHERE NOT (object_type = 'order' AND CAST(CASE WHEN object_type = 'order' THEN substr(object_id, 7) ELSE '1' END AS BIGINT) % 20 = 0)), bad AS (SELECT 'relation without event' AS kind, event_id AS id FROM eo WHERE event_id NOT IN (SELECT event_id FROM ev) UNION SELECT 'relation without object', object_id FROM eo WHERE object_id NOT IN (SELECT object_id FROM known) UNION SELECT 'object relation without source', source_id FROM oo WHERE source_id NOT IN (SELECT object_id FROM known) UNION SELECT 'object relation without target', target_id FROM oo WHERE target_id NOT IN (SELECT object_id FROM known))"
query("jn14_violations", B + " SELECT kind, count(*) AS n FROM bad GROUP BY 1")(lambda s, d: oc.violations(broken(s, d)).groupBy("kind").agg(F.count(F.lit(1)).alias("n")))
query("oc13_integrity", B + " SELECT kind, id FROM bad")(lambda s, d: oc.violations(broken(s, d)))
query("oc13_sound_log", "SELECT 0::BIGINT AS n")(lambda s, d: oc.violations(ocel(s, d)).agg(F.count(F.lit(1)).alias("n")))


def versions(s, d) -> DataFrame:
    """The total of a customer's orders as a versioned attribute."""
    orders = table(s, d, "orders")
    return orders.select(F.concat(F.lit("customer:"), "o_custkey").alias("object_id"), F.lit("last_total").alias("attr_name"), F.col("o_totalprice").cast("string").alias("attr_value"), F.lit("float").alias("attr_type"), F.col("o_orderdate").cast("timestamp").alias("timestamp"), "o_orderkey")


V = "WITH v AS (SELECT 'customer:' || o_custkey AS object_id, o_totalprice, o_orderdate, o_orderkey FROM orders)"
query("oc09_attributes_at", V + ", l AS (SELECT object_id, CAST(o_orderkey AS VARCHAR) AS attr_value, row_number() OVER (PARTITION BY object_id ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR) DESC) AS n FROM v WHERE o_orderdate <= TIMESTAMP '1997-01-01') SELECT object_id, 'last_order' AS attr_name, attr_value FROM l WHERE n = 1")(
    lambda s, d: oc.attributes_at(ocel(s, d).add("object_attribute", versions(s, d).select("object_id", F.lit("last_order").alias("attr_name"), F.col("o_orderkey").cast("string").alias("attr_value"), F.lit("int").alias("attr_type"), "timestamp")), "1997-01-01")
)
query("oc09_as_of_join", V + ", q AS (SELECT 'customer:' || c_custkey AS object_id, TIMESTAMP '1997-01-01' AS asked FROM customer), r AS (SELECT q.object_id, v.o_orderkey, row_number() OVER (PARTITION BY q.object_id ORDER BY v.o_orderdate DESC, v.o_orderkey DESC) AS n FROM q LEFT JOIN v ON q.object_id = v.object_id AND v.o_orderdate <= q.asked) SELECT object_id, coalesce(o_orderkey, -1) AS o_orderkey FROM r WHERE n = 1")(
    lambda s, d: intervals.as_of(table(s, d, "customer").select(F.concat(F.lit("customer:"), "c_custkey").alias("object_id"), F.expr("timestamp'1997-01-01'").alias("asked")), versions(s, d), ["object_id"], "asked", "timestamp", ["o_orderkey"], "o_orderkey").select("object_id", F.coalesce("o_orderkey", F.lit(-1)).alias("o_orderkey"))
)
query("oc10_attribute_text", "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS as_int, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%fZ') AS as_time FROM orders")(lambda s, d: table(s, d, "orders").select("o_orderkey", oc.to_text(F.col("o_orderkey"), "int").alias("as_int"), oc.to_text(F.col("o_orderdate"), "time").alias("as_time")))


@query("oc11_round_trip", O + " SELECT object_type, activity, next_activity, count(*) AS edge_count FROM flow WHERE next_activity IS NOT NULL GROUP BY 1, 2, 3")
def _round_trip(s, d) -> DataFrame:
    folder = scratch(s, "ocel")
    oc.write(ocel(s, d), folder)
    return oc.oc_dfg(oc.read(s, folder))


@query("oc12_inserts", O + " SELECT event_type, count(*) + CASE event_type WHEN 'Order Placed' THEN 1 ELSE 0 END AS n FROM ev GROUP BY event_type")
def _inserts(s, d) -> DataFrame:
    more = s.createDataFrame([("new", "Order Placed", None)], "event_id string, event_type string, timestamp timestamp")
    return ocel(s, d).add("events", more).events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("snk12_ocel_json", O + " SELECT 'event' AS part, event_type AS kind, count(*) AS n, CAST(min(timestamp) AS VARCHAR) AS least FROM ev GROUP BY 2 UNION ALL SELECT 'object', object_type, count(*), min(object_id) FROM ob GROUP BY 2 UNION ALL SELECT 'relation', qualifier, count(*), min(event_id || object_id) FROM (SELECT DISTINCT event_id, object_id, qualifier FROM eo) t GROUP BY 2")
def _json(s, d) -> DataFrame:
    folder = scratch(s, "oceljson")
    oc.write_json(ocel(s, d), folder)
    back = oc.read_json(s, folder)
    one = lambda df, part, kind, least: df.groupBy(F.lit(part).alias("part"), F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.min(least).alias("least"))
    time = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")
    return one(back.events, "event", "event_type", time).unionByName(one(back.objects, "object", "object_type", "object_id")).unionByName(one(back.event_object.distinct(), "relation", "qualifier", F.concat("event_id", "object_id")))


query("oc15_raw_sql", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")(lambda s, d: (table(s, d, "orders").createOrReplaceTempView("eventloom_orders"), s.sql("SELECT o_orderstatus, count(*) AS n FROM eventloom_orders GROUP BY 1"))[1])
DOCUMENT = '{"events": [{"id": "e1", "type": "Pay", "time": "2024-01-01T00:00:00Z", "relationships": [{"objectId": "o1", "qualifier": "of"}]}], "objects": [{"id": "o1", "type": "order", "relationships": [{"objectId": "c1", "qualifier": "by"}], "attributes": [{"name": "total", "value": 3, "time": "2024-01-01T00:00:00Z"}]}, {"id": "c1", "type": "customer"}]}'
query("src26_ocel_document", "SELECT 'o1' AS object_id, 'total' AS attr_name, '3' AS attr_value")(lambda s, d: oc.from_document(s, DOCUMENT).object_attribute.select("object_id", "attr_name", "attr_value"))
