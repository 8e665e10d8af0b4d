"""The registry of queries: a name, a function of (spark, folder), and SQL for the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.log import event_log
from eventloom.operators.ocel import Ocel
from eventloom.session import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def log(spark: SparkSession, d: str, keep: list[str] | None = None) -> DataFrame:
    """The events as a log: a user is a case; the resource is made of the event's number, every twelfth without one."""
    events = table(spark, d, "events")
    who = F.when(F.col("event_id") % 12 != 0, F.concat(F.lit("r"), (F.col("event_id") % 12).cast("string")))
    return event_log(events.withColumn("who", who), "user_id", "event_type", "ts", "who", "event_id", keep)


#: The same log in SQL, to start a WITH list.
E = """WITH e AS (
  SELECT CAST(user_id AS VARCHAR) AS case_id, event_type AS activity, epoch_us(ts) * 1000 AS timestamp,
    CASE WHEN event_id % 12 <> 0 THEN 'r' || CAST(event_id % 12 AS VARCHAR) END AS resource, event_id AS seq, value, ts, props
  FROM events
)"""


def ocel(spark: SparkSession, d: str) -> Ocel:
    """Orders and their items as object-centric events."""
    orders, items = table(spark, d, "orders"), table(spark, d, "lineitem")
    key = lambda prefix, *cols: F.concat(F.lit(prefix), F.concat_ws("_", *cols))
    item = key("l", "l_orderkey", "l_linenumber")
    events = orders.select(key("o", "o_orderkey").alias("event_id"), F.lit("Order Placed").alias("event_type"), F.col("o_orderdate").cast("timestamp").alias("timestamp"))
    events = events.unionByName(items.select(item.alias("event_id"), F.lit("Item Shipped").alias("event_type"), F.col("l_shipdate").cast("timestamp").alias("timestamp")))
    kinds = (("order", orders, "o_orderkey"), ("customer", table(spark, d, "customer"), "c_custkey"), ("part", table(spark, d, "part"), "p_partkey"), ("supplier", table(spark, d, "supplier"), "s_suppkey"))
    objects = [t.select(key(f"{k}:", c).alias("object_id"), F.lit(k).alias("object_type")) for k, t, c in kinds]
    related = [
        orders.select(key("o", "o_orderkey").alias("event_id"), key("order:", "o_orderkey").alias("object_id"), F.lit("places").alias("qualifier")),
        orders.select(key("o", "o_orderkey").alias("event_id"), key("customer:", "o_custkey").alias("object_id"), F.lit("by").alias("qualifier")),
        items.select(item.alias("event_id"), key("order:", "l_orderkey").alias("object_id"), F.lit("of").alias("qualifier")),
        items.select(item.alias("event_id"), key("part:", "l_partkey").alias("object_id"), F.lit("item").alias("qualifier")),
        items.select(item.alias("event_id"), key("supplier:", "l_suppkey").alias("object_id"), F.lit("from").alias("qualifier")),
    ]
    o2o = orders.select(key("customer:", "o_custkey").alias("source_id"), key("order:", "o_orderkey").alias("target_id"), F.lit("places").alias("qualifier"))
    o2o = o2o.unionByName(items.select(key("order:", "l_orderkey").alias("source_id"), key("part:", "l_partkey").alias("target_id"), F.lit("contains").alias("qualifier")).distinct())
    first = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionByName(first(frames[1:]))
    return Ocel(events, first(objects), first(related), o2o)


#: The same log in SQL.
O = """WITH ev AS (
  SELECT 'o' || o_orderkey AS event_id, 'Order Placed' AS event_type, o_orderdate AS timestamp FROM orders
  UNION ALL SELECT 'l' || l_orderkey || '_' || l_linenumber, 'Item Shipped', l_shipdate FROM lineitem
), ob AS (
  SELECT 'order:' || o_orderkey AS object_id, 'order' AS object_type FROM orders
  UNION ALL SELECT 'customer:' || c_custkey, 'customer' FROM customer
  UNION ALL SELECT 'part:' || p_partkey, 'part' FROM part
  UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier' FROM supplier
), eo AS (
  SELECT 'o' || o_orderkey AS event_id, 'order:' || o_orderkey AS object_id, 'places' AS qualifier FROM orders
  UNION ALL SELECT 'o' || o_orderkey, 'customer:' || o_custkey, 'by' FROM orders
  UNION ALL SELECT 'l' || l_orderkey || '_' || l_linenumber, 'order:' || l_orderkey, 'of' FROM lineitem
  UNION ALL SELECT 'l' || l_orderkey || '_' || l_linenumber, 'part:' || l_partkey, 'item' FROM lineitem
  UNION ALL SELECT 'l' || l_orderkey || '_' || l_linenumber, 'supplier:' || l_suppkey, 'from' FROM lineitem
), oo AS (
  SELECT 'customer:' || o_custkey AS source_id, 'order:' || o_orderkey AS target_id, 'places' AS qualifier FROM orders
  UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 'part:' || l_partkey, 'contains' FROM lineitem
), flow AS (
  SELECT object_type, object_id, event_id, event_type AS activity, timestamp,
    lead(event_type) OVER w AS next_activity, row_number() OVER w AS n
  FROM (SELECT DISTINCT object_type, object_id, event_id, event_type, timestamp FROM eo JOIN ev USING (event_id) JOIN ob USING (object_id)) t
  WINDOW w AS (PARTITION BY object_type, object_id ORDER BY timestamp, event_id)
)"""  # noqa: E741
