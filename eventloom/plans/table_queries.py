"""Queries over plain tables: filters, joins, profiles, samples, privacy, deduplication, healing, schemas, SQL breadth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.operators import filters, healing, privacy, quality, schemas
from eventloom.plans.registry import E, log, query
from eventloom.session import table

# filters
query("fil01_flat", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 400000")(lambda s, d: filters.select(table(s, d, "orders"), ["o_orderkey", "o_totalprice"], "o_totalprice > 400000"))
query("fil02_rules", E + " SELECT seq FROM e WHERE activity = 'view' AND coalesce(resource, '') NOT LIKE 'r1%'")(lambda s, d: filters.by_rules(log(s, d), [filters.Rule("activity", "eq", "view"), filters.Rule("resource", "prefix", "r1", exclude=True)]).select("seq"))
for _name, _rule, _sql in (
    ("ne", filters.Rule("activity", "ne", "view"), "activity <> 'view'"),
    ("contains", filters.Rule("activity", "contains", "ic"), "contains(activity, 'ic')"),
    ("suffix", filters.Rule("activity", "suffix", "e"), "suffix(activity, 'e')"),
    ("regex", filters.Rule("activity", "regex", "^[ce].*r"), "regexp_matches(activity, '^[ce].*r')"),
    ("empty", filters.Rule("resource", "empty"), "resource IS NULL"),
    ("notempty", filters.Rule("resource", "notempty"), "resource IS NOT NULL"),
    ("unknown", filters.Rule("resource", "gt", "3"), "false"),
):
    query(f"fil03_{_name}", E + f" SELECT seq FROM e WHERE {_sql}")(lambda s, d, r=_rule: filters.by_rules(log(s, d), [r]).select("seq"))
query("fil04_builder", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_returnflag IN ('A', 'R') AND l_linestatus LIKE 'F%' AND l_discount <> 0.05 AND l_tax IS NOT NULL")(
    lambda s, d: filters.select(
        table(s, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_quantity"], filters.Where().add("l_quantity", "between", (10, 20)).add("l_returnflag", "in", ["A", "R"]).add("l_linestatus", "like", "F%").add("l_discount", "<>", 0.05).add("l_tax", "is not null").add("l_tax", "in", [])
    )
)
query("fil05_time_range", "SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-05'")(lambda s, d: filters.time_range(table(s, d, "events"), "ts", F.lit("2024-01-03").cast("timestamp_ntz"), F.lit("2024-01-05").cast("timestamp_ntz")).select("event_id"))
query("fil05_count", "SELECT count(*) AS n FROM events WHERE event_type = 'click'")(lambda s, d: filters.select(table(s, d, "events"), where="event_type = 'click'").agg(F.count(F.lit(1)).alias("n")))
query("st05_limit", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 7")(lambda s, d: table(s, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").select("o_orderkey").limit(7))
query("fil06_mapping", "SELECT CAST(user_id AS VARCHAR) AS case_id, event_type AS activity, event_id FROM events")(lambda s, d: table(s, d, "events").withColumnsRenamed({"user_id": "case_id", "event_type": "activity"}).select(F.col("case_id").cast("string").alias("case_id"), "activity", "event_id"))
query("fil07_profile", "SELECT user_id AS case_id, event_type AS activity, value FROM events")(lambda s, d: filters.Profile({"case_id": "user_id", "activity": "event_type"}, include=("value", "props"), exclude=("props",)).apply(table(s, d, "events")))
query("fil08_batch_filter", "SELECT event_id FROM events WHERE value > 50")(lambda s, d: table(s, d, "events").transform(lambda x: x.where("value > 50")).select("event_id"))
query("fil09_derived_activity", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'Finish' WHEN o_totalprice > 200000 THEN 'Review' ELSE 'Open' END AS activity FROM orders")(lambda s, d: filters.derive(table(s, d, "orders"), "activity", [("o_orderstatus = 'F'", "Finish"), ("o_totalprice > 200000", "Review")], "Open").select("o_orderkey", "activity"))


@query("fil10_hooks", "SELECT event_type, count(*) AS n FROM events WHERE value > 10 GROUP BY 1")
def _hooks(s, d) -> DataFrame:
    from eventloom.plans.pipeline import Pipeline

    steps = Pipeline([lambda x: x.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))], before=[lambda x: x.where("value > 10")])
    return steps.apply(table(s, d, "events"))


# joins and user SQL
query("jn05_left_joins", "SELECT n_name, r_name, count(c_custkey) AS n FROM nation LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2")(
    lambda s, d: (lambda n, r, c: n.join(r, n.n_regionkey == r.r_regionkey, "left").join(c, c.c_nationkey == n.n_nationkey, "left").groupBy("n_name", "r_name").agg(F.count("c_custkey").alias("n")))(table(s, d, "nation"), table(s, d, "region"), table(s, d, "customer"))
)
query("jn16_unified_sources", "SELECT 'order' AS source, o_orderkey AS order_id, 'Order Placed' AS activity, o_orderdate AS event_time FROM orders UNION ALL SELECT 'shipping', l_orderkey, 'Item Shipped', l_shipdate FROM lineitem")(
    lambda s, d: table(s, d, "orders").select(F.lit("order").alias("source"), F.col("o_orderkey").alias("order_id"), F.lit("Order Placed").alias("activity"), F.col("o_orderdate").alias("event_time")).unionByName(
        table(s, d, "lineitem").select(F.lit("shipping").alias("source"), F.col("l_orderkey").alias("order_id"), F.lit("Item Shipped").alias("activity"), F.col("l_shipdate").alias("event_time"))
    )
)
query("sql_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")(lambda s, d: table(s, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n")))
query("sql_rollup", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")(lambda s, d: table(s, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("q")))
query("sql_pivot", "SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS F, count(*) FILTER (l_linestatus = 'O') AS O FROM lineitem GROUP BY 1")(lambda s, d: table(s, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1))).na.fill(0))
query("sql_semi_join", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")(lambda s, d: table(s, d, "customer").join(table(s, d, "orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey"))
query("sql_rank", "SELECT c_custkey, CAST(rank() OVER w AS INTEGER) AS r, CAST(dense_rank() OVER w AS INTEGER) AS dr, CAST(ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS q FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC)")(
    lambda s, d: s.sql(f"SELECT c_custkey, rank() OVER w AS r, dense_rank() OVER w AS dr, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS q FROM parquet.`{d}/customer.parquet` WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC)")
)
query("sql_frames", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS moving FROM events")(
    lambda s, d: s.sql(f"SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS moving FROM parquet.`{d}/events.parquet`")
)

# aggregates and quality
query("ag06_column_counts", "SELECT 'activity' AS column_name, count(*) AS n_rows, count(*) - count(event_type) AS n_nulls, count(DISTINCT event_type) AS n_distinct FROM events UNION ALL SELECT 'resource', count(*), count(*) FILTER (event_id % 12 = 0), count(DISTINCT CASE WHEN event_id % 12 <> 0 THEN event_id % 12 END) FROM events")(
    lambda s, d: quality.column_counts(log(s, d), ["activity", "resource"])
)
query("ag07_log_quality", E + " SELECT count(*) AS n_events, count(*) FILTER (case_id IS NULL) AS no_case, count(*) FILTER (activity IS NULL) AS no_activity, count(*) FILTER (timestamp <= 0) AS no_time, count(*) FILTER (resource IS NULL) AS no_resource, round(count(*) FILTER (case_id IS NOT NULL AND activity IS NOT NULL AND timestamp > 0) * 100.0::DOUBLE / count(*), 6) AS completeness FROM e")(
    lambda s, d: quality.log_quality(log(s, d))
)
#: A log with defects: events without activity, time or resource, and repeated ones.
DEFECTS = E + ", f AS (SELECT case_id, CASE WHEN seq % 50 <> 0 THEN activity END AS activity, CASE WHEN seq % 40 = 0 THEN 0 ELSE timestamp END AS timestamp, CASE WHEN seq % 3 = 0 THEN resource END AS resource FROM e), g AS (SELECT * FROM f UNION ALL SELECT case_id, activity, timestamp, resource FROM e WHERE seq % 30 = 1)"


def defective(s, d) -> DataFrame:
    e = log(s, d)
    broken = e.withColumn("activity", F.expr("case when seq % 50 <> 0 then activity end")).withColumn("timestamp", F.expr("case when seq % 40 = 0 then 0 else timestamp end")).withColumn("resource", F.expr("case when seq % 3 = 0 then resource end"))
    return broken.unionByName(e.where("seq % 30 = 1"))


query(
    "ql02_issues",
    DEFECTS + ", c AS (SELECT avg(n) AS mean, count(*) FILTER (n = 1) / count(*) AS single FROM (SELECT case_id, count(*) AS n FROM g GROUP BY 1) t) SELECT * FROM (SELECT 'error' AS severity, 'events without an activity' AS issue, count(*) FILTER (activity IS NULL) AS n FROM g UNION ALL SELECT 'error', 'events without a time', count(*) FILTER (timestamp <= 0) FROM g UNION ALL SELECT 'warning', 'repeated events', CAST(sum(k - 1) AS BIGINT) FROM (SELECT count(*) AS k FROM g GROUP BY case_id, activity, timestamp) t UNION ALL SELECT 'warning', 'over half the events without a resource', CASE WHEN count(*) FILTER (resource IS NULL) * 2 > count(*) THEN count(*) FILTER (resource IS NULL) ELSE 0 END FROM g UNION ALL SELECT 'warning', 'under two events per case', CASE WHEN (SELECT mean FROM c) < 2 THEN count(*) ELSE 0 END FROM g UNION ALL SELECT 'warning', 'over 30 % of cases with one event', CASE WHEN (SELECT single FROM c) > 0.3 THEN count(*) ELSE 0 END FROM g) t WHERE n > 0",
)(lambda s, d: quality.issues(defective(s, d)))
query("ql01_top_values", E + ", v AS (SELECT 'activity' AS column_name, activity AS value FROM e UNION ALL SELECT 'resource', resource FROM e WHERE resource IS NOT NULL), k AS (SELECT column_name, value, count(*) AS n FROM v GROUP BY 1, 2), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS INTEGER) AS rank, sum(n) OVER (PARTITION BY column_name) AS total FROM k) SELECT column_name, value, n, round(n * 100.0::DOUBLE / total, 6) AS share, rank FROM r WHERE rank <= 10")(lambda s, d: quality.top_values(log(s, d), ["activity", "resource"]))
query("ql01_report", E + ", c AS (SELECT case_id, count(*) AS n FROM e GROUP BY 1), k AS (SELECT 'top activity' AS section, activity AS name, CAST(count(*) AS DOUBLE) AS value FROM e GROUP BY 2 UNION ALL SELECT 'top resource', resource, CAST(count(*) AS DOUBLE) FROM e WHERE resource IS NOT NULL GROUP BY 2), t AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY value DESC, name) AS rank FROM k) SELECT section, name, value FROM t WHERE rank <= 10 UNION ALL SELECT 'uniqueness', 'case_id', count(DISTINCT case_id) FROM e UNION ALL SELECT 'uniqueness', 'activity', count(DISTINCT activity) FROM e UNION ALL SELECT 'uniqueness', 'resource', count(DISTINCT resource) FROM e UNION ALL SELECT 'events per case', 'least', min(n) FROM c UNION ALL SELECT 'events per case', 'most', max(n) FROM c UNION ALL SELECT 'events per case', 'mean', round(avg(n), 6) FROM c")(
    lambda s, d: quality.report(log(s, d)).where("section <> 'completeness'")
)
query("ql04_quality_score", E + " SELECT round((100.0::DOUBLE + 100 + 100 + count(resource) * 100.0::DOUBLE / count(*) + 100) / 5, 6) AS score, CAST(0 AS BIGINT) AS n_constant, CAST(0 AS BIGINT) AS n_mostly_null FROM e")(lambda s, d: quality.quality_score(log(s, d)))
query("ag13_distinct_sketch", "SELECT true AS close")(
    lambda s, d: quality.approximate_distinct(table(s, d, "lineitem"), "l_partkey").join(table(s, d, "lineitem").agg(F.countDistinct("l_partkey").alias("exact"))).select((F.abs(F.col("estimate") - F.col("exact")) <= F.col("exact") * 0.03).alias("close"))
)
query("ag13_merged_sketch", "SELECT true AS close")(
    lambda s, d: quality.merged_distinct(table(s, d, "lineitem"), "l_partkey", "l_returnflag").join(table(s, d, "lineitem").agg(F.countDistinct("l_partkey").alias("exact"))).select((F.abs(F.col("estimate") - F.col("exact")) <= F.col("exact") * 0.03).alias("close"))
)
query("ag14_entropy", "WITH p AS (SELECT count(*) / sum(count(*)) OVER () AS p FROM events GROUP BY event_type) SELECT round(-sum(p * log2(p)), 6) AS entropy, round(-sum(p * log2(p)) / log2(count(*)), 6) AS normalised FROM p")(lambda s, d: quality.entropy(table(s, d, "events"), "event_type"))
query(
    "ag15_profile",
    "WITH c AS (SELECT 'o_orderkey' AS column_name, count(*) AS n_rows, count(*) - count(o_orderkey) AS n_nulls, count(DISTINCT o_orderkey) AS n_distinct, min(CAST(o_orderkey AS VARCHAR)) AS min_value, max(CAST(o_orderkey AS VARCHAR)) AS max_value FROM orders UNION ALL SELECT 'o_orderstatus', count(*), count(*) - count(o_orderstatus), count(DISTINCT o_orderstatus), min(o_orderstatus), max(o_orderstatus) FROM orders) SELECT *, round(n_nulls * 100.0::DOUBLE / n_rows, 6) AS null_percent, round(n_distinct / (n_rows - n_nulls)::DOUBLE, 6) AS unique_ratio, CASE WHEN n_distinct / (n_rows - n_nulls)::DOUBLE > 0.99 THEN 'unique' WHEN n_distinct / (n_rows - n_nulls)::DOUBLE > 0.5 THEN 'high' WHEN n_distinct / (n_rows - n_nulls)::DOUBLE > 0.1 THEN 'medium' ELSE 'low' END AS uniqueness FROM c",
)(lambda s, d: quality.profile(table(s, d, "orders"), ["o_orderkey", "o_orderstatus"]))
query("ag16_null_rates", E + " SELECT 'resource' AS column_name, round(count(*) FILTER (resource IS NULL) * 100.0::DOUBLE / count(*), 6) AS null_percent FROM e UNION ALL SELECT 'activity', 0.0::DOUBLE FROM (SELECT 1)")(lambda s, d: quality.profile(log(s, d), ["resource", "activity"]).select("column_name", "null_percent"))
query("ag17_checksum", None)(lambda s, d: quality.checksum(table(s, d, "orders")))
query("ag17_checksum_order_free", "SELECT true AS equal")(lambda s, d: quality.checksum(table(s, d, "orders")).join(quality.checksum(table(s, d, "orders").orderBy(F.desc("o_totalprice"))).select(F.col("xor").alias("x"), F.col("total").alias("t"))).select(((F.col("xor") == F.col("x")) & (F.col("total") == F.col("t"))).alias("equal")))
query("ag26_percentiles", "WITH l AS (SELECT list_sort(list(value)) AS v FROM events) SELECT v[least(floor(len(v) * 0.5), len(v) - 1)::INT + 1] AS p50, v[least(floor(len(v) * 0.95), len(v) - 1)::INT + 1] AS p95, v[least(floor(len(v) * 0.99), len(v) - 1)::INT + 1] AS p99 FROM l")(lambda s, d: quality.rank_percentiles(table(s, d, "events"), "value"))
query("ag27_row_counts", "SELECT (SELECT count(*) FROM lineitem) AS n_rows, CAST(11 AS INTEGER) AS n_columns")(lambda s, d: (lambda t: t.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(t.columns))))(table(s, d, "lineitem")))
query("ag30_type_votes", "SELECT CASE WHEN i % 10 = 0 THEN 'null' WHEN i % 10 = 1 THEN 'bool' WHEN i % 10 = 2 THEN 'float' WHEN i % 10 = 3 THEN 'timestamp' WHEN i % 10 = 4 THEN 'string' ELSE 'int' END AS kind, count(*) AS n FROM (SELECT event_id AS i FROM events) t GROUP BY 1")(
    lambda s, d: quality.type_votes(table(s, d, "events").select(F.expr("CASE WHEN event_id % 10 = 0 THEN 'N/A' WHEN event_id % 10 = 1 THEN 'Yes' WHEN event_id % 10 = 2 THEN cast(value as string) WHEN event_id % 10 = 3 THEN '2024-01-02 03:04:05' WHEN event_id % 10 = 4 THEN event_type ELSE cast(event_id as string) END").alias("x")).where("x not rlike '^[0-9]+$' or true"), "x")
)


@query("ql06_contract", "SELECT unnest(['error: column o_totalprice is bigint, not double', 'error: column o_orderstatus has 100.00 % nulls, over 1.0']) AS violation")
def _contract(s, d) -> DataFrame:
    orders = table(s, d, "orders")
    promise = quality.Contract.from_json(quality.make_contract(orders, "orders", max_null_percent={"o_orderstatus": 1.0}).to_json())
    changed = orders.withColumn("o_totalprice", F.col("o_totalprice").cast("long")).withColumn("o_orderstatus", F.lit(None).cast("string"))
    return s.createDataFrame([(x,) for x in quality.violations(changed, promise)], "violation string")


# samples, privacy, duplicates
query("sm01_rate", None)(lambda s, d: privacy.rate_sample(table(s, d, "events"), 0.2, ["event_id"], 3).select("event_id"))
query("sm01_rate_share", "SELECT true AS near")(lambda s, d: privacy.rate_sample(table(s, d, "lineitem"), 0.5, ["l_orderkey", "l_linenumber", "l_partkey"]).agg(F.count(F.lit(1)).alias("k")).join(table(s, d, "lineitem").agg(F.count(F.lit(1)).alias("n"))).select((F.abs(F.col("k") / F.col("n") - 0.5) < 0.03).alias("near")))
query("sm02_reservoir", "SELECT CAST(100 AS BIGINT) AS n")(lambda s, d: privacy.reservoir_sample(table(s, d, "events"), 100, ["event_id"], 3).agg(F.countDistinct("event_id").alias("n")))
query("sm03_stratified", "SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) <= 3")(lambda s, d: privacy.stratified_sample(table(s, d, "events"), "event_type", 3, "event_id").select("event_id", "event_type"))
query("sm04_strategy", "SELECT CAST(5 AS BIGINT) AS n")(lambda s, d: privacy.sample(table(s, d, "events"), ["event_id"], count=5, stratify="event_type").agg(F.count(F.lit(1)).alias("n")))
query("pv01_anonymise", E + " SELECT seq, substr(sha256('salt' || case_id), 1, 16) AS case_id, substr(sha256('salt' || resource), 1, 16) AS resource FROM e")(lambda s, d: privacy.anonymise(log(s, d), ["case_id", "resource"], "salt").select("seq", "case_id", "resource"))
query("pv02_pseudonymise", E + ", r AS (SELECT resource, 'R' || row_number() OVER (ORDER BY resource) AS name FROM (SELECT DISTINCT resource FROM e WHERE resource IS NOT NULL)) SELECT seq, name AS resource FROM e LEFT JOIN r USING (resource)")(lambda s, d: privacy.pseudonymise(log(s, d), {"resource": "R"}).select("seq", "resource"))
query("dd01_keep_first", "SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1")(lambda s, d: privacy.deduplicate(table(s, d, "events"), ["user_id", "event_type"], "event_id").select("event_id", "user_id", "event_type"))
query("dd02_replace", "SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")(lambda s, d: privacy.deduplicate(table(s, d, "events"), ["user_id", "event_type"], "event_id", "replace").select("event_id", "user_id", "event_type"))
query("dd02_repeats", "SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_unique, CAST(sum(n - 1) AS BIGINT) AS n_duplicates FROM (SELECT count(*) AS n FROM events GROUP BY user_id, event_type)")(lambda s, d: privacy.repeats(table(s, d, "events"), ["user_id", "event_type"]))


@query("dd04_bloom", "SELECT CAST(0 AS BIGINT) AS missed, true AS few_false")
def _bloom(s, d) -> DataFrame:
    bits, hashes = privacy.bloom_bits(20_000, 0.01)
    keys = table(s, d, "orders").select(F.col("o_orderkey").alias("k"))
    even, odd = keys.where("k % 2 = 0"), keys.where("k % 2 = 1")
    made = privacy.bloom_filter(even, "k", bits, hashes)
    found = privacy.maybe_contained(keys.withColumn("v", F.col("k")), "k", "v", made, bits, hashes)
    hit = found.agg(F.count_if(F.col("k") % 2 == 0).alias("hit"), F.count_if(F.col("k") % 2 == 1).alias("wrong"))
    sizes = even.agg(F.count(F.lit(1)).alias("n_even")).join(odd.agg(F.count(F.lit(1)).alias("n_odd")))
    return hit.join(sizes).select((F.col("n_even") - F.col("hit")).alias("missed"), (F.col("wrong") <= F.col("n_odd") * 0.03).alias("few_false"))


query("dd05_record_keys", "SELECT count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events)")(lambda s, d: table(s, d, "events").select(privacy.record_key(table(s, d, "events"), ["user_id", "event_type"]).alias("k")).distinct().agg(F.count(F.lit(1)).alias("n")))

# healing: rows with planted damage
DAMAGE = """CASE event_id % 8 WHEN 0 THEN '"' || event_type || ',x' WHEN 1 THEN ' ' || event_type || ',x ' WHEN 2 THEN event_type || '&amp;' || event_type || ',x' WHEN 3 THEN event_type || ';a;b;c;d'
  WHEN 4 THEN event_type || ',x' || chr(13) WHEN 5 THEN event_type || ',x\\' WHEN 6 THEN event_type || ',x,y' ELSE event_type || ',x' END"""


def damaged(s, d) -> DataFrame:
    return table(s, d, "events").select("event_id", F.expr(DAMAGE.replace("x\\'", "x\\\\'")).alias("line"))


G = f"WITH g AS (SELECT event_id, event_type, {DAMAGE} AS line FROM events)"
query("hl01_patterns", G + " SELECT event_id, list_sort(list_concat(CASE WHEN event_id % 8 IN (0) THEN ['odd_quotes'] WHEN event_id % 8 = 1 THEN ['outer_space'] WHEN event_id % 8 = 2 THEN ['html_entity'] WHEN event_id % 8 = 3 THEN ['column_count', 'wrong_delimiter'] WHEN event_id % 8 = 4 THEN ['carriage_return'] WHEN event_id % 8 = 5 THEN ['escape'] WHEN event_id % 8 = 6 THEN ['column_count'] ELSE CAST([] AS VARCHAR[]) END, CAST([] AS VARCHAR[])))::VARCHAR AS found FROM g")(
    lambda s, d: damaged(s, d).select("event_id", F.concat(F.lit("["), F.array_join(F.array_sort(F.transform(healing.patterns("line", ",", 2), lambda p: p["pattern"])), ", "), F.lit("]")).alias("found"))
)
query("hl03_quotes", G + " SELECT event_id, CASE WHEN event_id % 8 = 0 THEN line || '\"' ELSE line END AS line FROM g")(lambda s, d: damaged(s, d).withColumn("line", healing.fix_quotes(F.col("line"))))
query("hl04_delimiter", G + " SELECT event_id, CASE WHEN event_id % 8 = 3 THEN replace(line, ';', ',') ELSE line END AS line FROM g")(lambda s, d: damaged(s, d).withColumn("line", healing.fix_delimiter(F.col("line"))))
query("hl05_newlines_space", G + " SELECT event_id, trim(replace(replace(line, chr(13) || chr(10), chr(10)), chr(13), chr(10)), ' ') AS line FROM g")(lambda s, d: damaged(s, d).withColumn("line", healing.fix_space(healing.fix_nul(healing.fix_newlines(F.col("line"))))))
query("hl06_entities", G + " SELECT event_id, replace(line, '&amp;', '&') AS line FROM g")(lambda s, d: damaged(s, d).withColumn("line", healing.fix_entities(F.col("line"))))
query("hl06_escapes", G + " SELECT event_id, CASE WHEN event_id % 8 = 5 THEN left(line, len(line) - 1) ELSE line END AS line FROM g")(lambda s, d: damaged(s, d).withColumn("line", healing.fix_escapes(F.col("line"))))
query("hl07_columns", G + " SELECT event_id, array_to_string(list_concat(string_split(line, ','), ['', ''])[1:3], ',') AS line FROM g")(lambda s, d: damaged(s, d).withColumn("line", healing.fix_columns(F.col("line"), 3)))
query("hl08_healed", G + " SELECT event_id, CASE event_id % 8 WHEN 0 THEN '\"' || event_type || ',x\"' WHEN 2 THEN event_type || '&' || event_type || ',x' WHEN 3 THEN event_type || ',a' ELSE event_type || ',x' END AS line FROM g WHERE event_id % 8 NOT IN (4)")(lambda s, d: damaged(s, d).where("event_id % 8 <> 4").withColumn("line", healing.heal("line", ",", 2)))
query("hl09_corpus", G + " SELECT p AS pattern, count(*) AS n_rows FROM (SELECT unnest(CASE event_id % 8 WHEN 0 THEN ['odd_quotes'] WHEN 1 THEN ['outer_space'] WHEN 2 THEN ['html_entity'] WHEN 3 THEN ['column_count', 'wrong_delimiter'] WHEN 4 THEN ['carriage_return'] WHEN 5 THEN ['escape'] WHEN 6 THEN ['column_count'] ELSE [] END) AS p FROM g) GROUP BY 1")(
    lambda s, d: healing.corpus_patterns(damaged(s, d), "line", delimiter=",", columns=2)
)
query("hl09_rules", G + " SELECT CASE event_id % 8 WHEN 0 THEN 'quotes' WHEN 1 THEN 'whitespace' WHEN 2 THEN 'entities' WHEN 4 THEN 'newlines' WHEN 5 THEN 'escapes' END AS rule, count(*) AS n_rows FROM g WHERE event_id % 8 IN (0, 1, 2, 4, 5) GROUP BY 1 UNION ALL SELECT 'delimiter', count(*) FROM g WHERE event_id % 8 = 3 UNION ALL SELECT 'columns', count(*) FROM g WHERE event_id % 8 IN (3, 6)")(
    lambda s, d: healing.recommended_rules(damaged(s, d), "line", delimiter=",", columns=2)
)
query("hl10_fix_statistics", G + " SELECT count(*) AS n_rows, count(*) FILTER (event_id % 8 <> 7) AS n_damaged, count(*) FILTER (event_id % 8 <> 7) AS n_changed FROM g")(lambda s, d: healing.fix_statistics(damaged(s, d), "line", delimiter=",", columns=2).drop("n_fixed"))
query("hl02_encoding", "SELECT event_id, 'café' AS word FROM events")(lambda s, d: table(s, d, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.unhex(F.lit("636166C3A9"))).otherwise(F.unhex(F.lit("636166E9"))).alias("b")).select("event_id", healing.from_bytes("b").alias("word")))
query("er01_skip", "SELECT event_id FROM events WHERE value >= 5")(lambda s, d: healing.with_policy(table(s, d, "events"), F.when(F.col("value") < 5, "value too small"), "skip").select("event_id"))
query("er02_error_kinds", "SELECT CASE WHEN value < 5 THEN 'value too small' ELSE 'value too large' END AS error, count(*) AS n FROM events WHERE value < 5 OR value > 100 GROUP BY 1")(
    lambda s, d: healing.split_errors(table(s, d, "events"), F.when(F.col("value") < 5, "value too small").when(F.col("value") > 100, "value too large"))[1].groupBy("error").agg(F.count(F.lit(1)).alias("n"))
)
query("er03_poison_rows", "SELECT doc_id FROM documents WHERE strlen(text) <= 5000")(lambda s, d: table(s, d, "documents").where(F.octet_length("text") <= 5000).select("doc_id"))


# schemas
@query("sc01_changes", "SELECT * FROM (VALUES ('a', 'type_changed', 'int -> bigint', false), ('b', 'removed', 'string', true), ('c', 'added', 'double', false), ('d', 'type_changed', 'string -> int', true)) t(column_name, kind, detail, breaking)")
def _changes(s, d) -> DataFrame:
    old, new = s.createDataFrame([], "a int, b string, d string").schema, s.createDataFrame([], "a bigint, c double, d int").schema
    return s.createDataFrame([(c.column, c.kind, c.detail, c.breaking) for c in schemas.compare(old, new)], "column_name string, kind string, detail string, breaking boolean")


query("sc03_union", "SELECT o_orderkey AS k, o_totalprice AS v, NULL::VARCHAR AS name FROM orders UNION ALL SELECT c_custkey, c_acctbal, c_name FROM customer")(
    lambda s, d: schemas.union([table(s, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v")), table(s, d, "customer").select(F.col("c_custkey").cast("int").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("v"))]).select("k", "v", "name")
)


@query("sc04_versions", "SELECT * FROM (VALUES (1, 'struct<a:int>'), (2, 'struct<a:bigint,b:string>')) t(version, fields)")
def _versions(s, d) -> DataFrame:
    history = schemas.SchemaHistory()
    for text in ("a int", "a bigint, b string", "a int"):
        history.update(s.createDataFrame([], text).schema)
    return s.createDataFrame([(i + 1, v.simpleString()) for i, v in enumerate(history.versions)], "version int, fields string")


query("sc05_inferred", "SELECT * FROM (VALUES ('event_id', 'bigint'), ('event_type', 'string'), ('value', 'double')) t(column_name, type)")(
    lambda s, d: s.createDataFrame([(f.name, f.dataType.simpleString()) for f in schemas.inferred(table(s, d, "events").select(*[F.col(c).cast("string").alias(c) for c in ("event_id", "event_type", "value")]))], "column_name string, type string")
)
query("sc06_describe", "SELECT * FROM (VALUES ('n_nationkey', 'int'), ('n_name', 'string'), ('n_regionkey', 'int')) t(column_name, type)")(lambda s, d: s.createDataFrame([(c, "int" if t in ("int", "bigint") else t) for c, t in table(s, d, "nation").dtypes], "column_name string, type string"))
