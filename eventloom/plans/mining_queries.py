"""Queries over the event log: statistics, sequences, trees, differences, star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom import log as logs
from eventloom.log import as_timestamp
from eventloom.operators import diff, intervals, mining, star, tree
from eventloom.plans.registry import E, log, query
from eventloom.session import table

query("dfg", E + ", f AS (SELECT activity, lead(activity) OVER (PARTITION BY case_id ORDER BY timestamp, seq) AS next_activity FROM e) SELECT activity, next_activity, count(*) AS edge_count FROM f WHERE next_activity IS NOT NULL GROUP BY 1, 2")(lambda s, d: mining.dfg(log(s, d)))
query("st04_frequent_edges", E + ", f AS (SELECT activity, lead(activity) OVER (PARTITION BY case_id ORDER BY timestamp, seq) AS next_activity FROM e) SELECT activity, next_activity, count(*) AS edge_count FROM f WHERE next_activity IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 300")(
    lambda s, d: mining.dfg(log(s, d), least=300).orderBy(F.desc("edge_count"), "activity", "next_activity")
)
query("ag01_distinct_counts", E + " SELECT count(*) AS n_events, count(DISTINCT case_id) AS n_cases, count(DISTINCT activity) AS n_activities, count(DISTINCT resource) AS n_resources FROM e")(lambda s, d: mining.distinct_counts(log(s, d)))
query("ag02_time_range", E + " SELECT min(timestamp) AS first_ts, max(timestamp) AS last_ts FROM e")(lambda s, d: mining.time_range(log(s, d)))
query("ag03_events_per_case", E + " SELECT min(n) AS min_events, max(n) AS max_events, round(avg(n), 6) AS avg_events FROM (SELECT count(*) AS n FROM e GROUP BY case_id)")(lambda s, d: mining.events_per_case(log(s, d)))
query("ag08_median_events", E + " SELECT list_sort(list(n))[len(list(n)) // 2 + 1] AS median_events FROM (SELECT count(*) AS n FROM e GROUP BY case_id)")(lambda s, d: mining.median_events(log(s, d)))
query("ag04_activity_share", E + " SELECT activity, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM e GROUP BY activity")(lambda s, d: mining.activity_share(log(s, d)))
query("wn04_resource_share", E + " SELECT resource, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM e GROUP BY resource")(lambda s, d: mining.activity_share(log(s, d), "resource"))
query("st02_top_activities", E + " SELECT activity, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM e GROUP BY activity ORDER BY n DESC, activity LIMIT 3")(lambda s, d: mining.activity_share(log(s, d), limit=3))
query("ag05_variants", E + ", v AS (SELECT string_agg(activity, ' -> ' ORDER BY timestamp, seq) AS variant FROM e GROUP BY case_id) SELECT variant, count(*) AS n_cases, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM v GROUP BY variant")(lambda s, d: mining.variants(log(s, d)))
query("ag09_average_duration", E + ", c AS (SELECT max(timestamp) - min(timestamp) AS x FROM e WHERE timestamp > 0 GROUP BY case_id) SELECT CAST(sum(x) // count(*) AS BIGINT) AS avg_duration, count(*) AS n_cases FROM c")(lambda s, d: mining.average_duration(log(s, d)))
query("ag09_case_durations", E + " SELECT case_id, min(timestamp) AS start_ts, max(timestamp) AS end_ts, count(*) AS n_events, max(timestamp) - min(timestamp) AS duration FROM e WHERE timestamp > 0 GROUP BY case_id")(lambda s, d: mining.case_durations(log(s, d)))
query("wn01_next_activity", E + " SELECT seq, lead(activity) OVER w AS next_activity, coalesce(lead(timestamp) OVER w, -1) AS next_ts FROM e WINDOW w AS (PARTITION BY case_id ORDER BY timestamp, seq)")(lambda s, d: mining.follows(log(s, d)).select("seq", "next_activity", F.coalesce("next_ts", F.lit(-1)).alias("next_ts")))
query(
    "wn02_start_end",
    E + ", m AS (SELECT activity, row_number() OVER (PARTITION BY case_id ORDER BY timestamp, seq) AS a, row_number() OVER (PARTITION BY case_id ORDER BY timestamp DESC, seq DESC) AS b FROM e) SELECT activity, count(*) FILTER (a = 1) AS n_starts, count(*) FILTER (b = 1) AS n_ends FROM m GROUP BY activity HAVING n_starts + n_ends > 0",
)(lambda s, d: mining.ends(log(s, d)))
query("wn03_since_previous", E + " SELECT seq, timestamp - coalesce(lag(timestamp) OVER (PARTITION BY case_id ORDER BY timestamp, seq), timestamp) AS since_previous FROM e")(lambda s, d: mining.gaps(log(s, d)).select("seq", "since_previous"))

I = E + ', iv AS (SELECT case_id, activity, seq, timestamp AS "start", coalesce(lead(timestamp) OVER (PARTITION BY case_id ORDER BY timestamp, seq), timestamp) AS "end" FROM e)'  # noqa: E741
query("wn07_intervals", I + ' SELECT seq, "start", "end", "end" - "start" AS duration FROM iv')(lambda s, d: mining.intervals(log(s, d)).select("seq", "start", "end", "duration"))
query("pm13_interval_lengths", I + ' SELECT activity, count(*) AS n, min("end" - "start") AS shortest FROM iv GROUP BY activity')(lambda s, d: mining.intervals(log(s, d)).groupBy("activity").agg(F.count(F.lit(1)).alias("n"), F.min("duration").alias("shortest")))
# the totals are BIGINT in SQL, which fails beyond that; as_long has decimals there
BOTTLE = 'CAST(sum("end" - "start") AS BIGINT) AS total_duration, count(*) AS n, CAST(sum("end" - "start") // count(*) AS BIGINT) AS avg_duration, max("end" - "start") AS max_duration'
query("ag18_bottlenecks", I + f" SELECT activity, {BOTTLE} FROM iv GROUP BY activity ORDER BY total_duration DESC, activity LIMIT 10")(lambda s, d: mining.as_long(mining.bottlenecks(mining.intervals(log(s, d))), "total_duration"))
DAY = 86_400_000_000_000
FIRST = 1_704_067_200_000_000_000
query("ag18_bottlenecks_in_range", I + f' SELECT activity, {BOTTLE} FROM iv WHERE "end" >= {FIRST + DAY} AND "start" <= {FIRST + 9 * DAY} GROUP BY activity ORDER BY total_duration DESC, activity LIMIT 3')(
    lambda s, d: mining.as_long(mining.bottlenecks(mining.intervals(log(s, d)), FIRST + DAY, FIRST + 9 * DAY, limit=3), "total_duration")
)
query(
    "ag19_sequence_bottlenecks",
    I + f", t AS (SELECT list(activity ORDER BY timestamp, seq)[1:2] AS p FROM e GROUP BY case_id) SELECT activity, {BOTTLE} FROM iv WHERE activity IN ('view', 'click') AND EXISTS (SELECT 1 FROM t WHERE p = ['view', 'click']) GROUP BY activity",
)(lambda s, d: mining.as_long(mining.sequence_bottlenecks(log(s, d), ["view", "click"]), "total_duration"))
query("wn08_out_of_order", E + ", p AS (SELECT timestamp, lag(timestamp) OVER (ORDER BY seq) AS b FROM e WHERE timestamp > 0) SELECT count(*) FILTER (timestamp < b) AS n_out_of_order FROM p")(lambda s, d: mining.out_of_order(log(s, d)))
query("wn09_duplicates", E + " SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS n_duplicates FROM (SELECT count(*) AS n FROM e GROUP BY case_id, activity, timestamp)")(lambda s, d: mining.duplicates(log(s, d)))
query(
    "pm01_report",
    E + ", c AS (SELECT count(*) AS n, min(timestamp) AS a, max(timestamp) AS b FROM e GROUP BY case_id), w AS (SELECT CAST(sum(n) AS BIGINT) AS n_events, count(*) AS n_cases, min(a) AS first_ts, max(b) AS last_ts, min(n) AS min_events, max(n) AS max_events FROM c) UNPIVOT w ON COLUMNS(*) INTO NAME metric VALUE value",
)(lambda s, d: mining.report(log(s, d)))


@query("pm02_detected_roles", "SELECT * FROM (VALUES ('case_id', 'user_id'), ('activity', 'event_type'), ('timestamp', 'ts')) t(role, column_name)")
def _roles(s, d) -> DataFrame:
    return s.createDataFrame(list(logs.detect_roles(table(s, d, "events").columns).items()), "role string, column_name string")


@query("pm03_missing_roles", "SELECT unnest(['activity', 'case_id', 'timestamp']) AS missing")
def _missing(s, d) -> DataFrame:
    return s.createDataFrame([(x,) for x in logs.missing_roles(table(s, d, "events").columns)], "missing string")


# prefix trees: paths of four steps, so that the SQL side can hold them
T = E + """, tr AS (SELECT case_id, list(activity ORDER BY timestamp, seq)[1:4] AS p, list(timestamp ORDER BY timestamp, seq) AS t FROM e GROUP BY case_id),
h AS (
  SELECT case_id, 0 AS depth, '' AS activity, sha256('__ROOT__') AS node_hash, '' AS parent_hash, CAST(NULL AS BIGINT) AS duration FROM tr
), h1 AS (
  SELECT case_id, 1 AS depth, p[1] AS activity, sha256(encode(p[1]) || unhex(sha256('__ROOT__'))) AS node_hash, sha256('__ROOT__') AS parent_hash, t[2] - t[1] AS duration FROM tr WHERE len(p) >= 1
), h2 AS (
  SELECT tr.case_id, 2 AS depth, p[2] AS activity, sha256(encode(p[2]) || unhex(h1.node_hash)) AS node_hash, h1.node_hash AS parent_hash, t[3] - t[2] AS duration FROM tr JOIN h1 USING (case_id) WHERE len(p) >= 2
), h3 AS (
  SELECT tr.case_id, 3 AS depth, p[3] AS activity, sha256(encode(p[3]) || unhex(h2.node_hash)) AS node_hash, h2.node_hash AS parent_hash, t[4] - t[3] AS duration FROM tr JOIN h2 USING (case_id) WHERE len(p) >= 3
), h4 AS (
  SELECT tr.case_id, 4 AS depth, p[4] AS activity, sha256(encode(p[4]) || unhex(h3.node_hash)) AS node_hash, h3.node_hash AS parent_hash, t[5] - t[4] AS duration FROM tr JOIN h3 USING (case_id) WHERE len(p) >= 4
), n AS (
  SELECT depth, activity, node_hash, parent_hash, count(*) AS case_count, round(avg(duration), 3) AS avg_duration
  FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3 UNION ALL SELECT * FROM h4) x GROUP BY 1, 2, 3, 4
)"""
query("ag20_tree_nodes", T + " SELECT * FROM n")(lambda s, d: tree.nodes(log(s, d), 4))
query("pm05_first_hashes", T + " SELECT activity, node_hash FROM n WHERE depth = 1")(lambda s, d: tree.nodes(log(s, d), 1).select("activity", "node_hash"))
query("pm08_tree_variants", T + " SELECT node_hash, case_count FROM n WHERE node_hash NOT IN (SELECT parent_hash FROM n)")(lambda s, d: tree.leaves(tree.nodes(log(s, d), 4)).select("node_hash", "case_count"))
query("pm09_has_path", T + " SELECT count(*) > 0 AS has_path FROM tr WHERE p[1:2] = ['view', 'click']")(lambda s, d: tree.has_path(log(s, d), ["view", "click"]))
query("jn15_cases_with_path", T + " SELECT case_id FROM tr WHERE p[1:2] = ['view', 'click']")(lambda s, d: logs.traces(log(s, d)).where(F.slice("trace", 1, 2) == F.array(F.lit("view"), F.lit("click"))).select("case_id"))
query("pm12_paths", T + " SELECT array_to_string(p, ' -> ') AS path, count(*) AS n FROM tr GROUP BY 1")(lambda s, d: logs.traces(log(s, d)).select(tree.render(F.slice("trace", 1, 4)).alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("n")))
query("pm04_traces", E + " SELECT case_id, md5(string_agg(activity, '>' ORDER BY timestamp, seq)) AS trace FROM e GROUP BY case_id")(lambda s, d: logs.traces(log(s, d)).select("case_id", F.md5(F.array_join("trace", ">")).alias("trace")))
#: Subtree hashes from nodes n(depth, node_hash, parent_hash, case_count): from the deepest level up, a level a step.
UP = """, r AS (SELECT depth, node_hash, parent_hash, case_count FROM n UNION ALL SELECT 0, sha256('__ROOT__'), '', CAST((SELECT sum(case_count) FROM n WHERE depth = 1) AS BIGINT)),
le AS (SELECT *, lpad(hex(case_count), 16, '0') AS x FROM r),
d AS (SELECT depth, node_hash, parent_hash, x[15:16] || x[13:14] || x[11:12] || x[9:10] || x[7:8] || x[5:6] || x[3:4] || x[1:2] AS count_hex FROM le),
up(depth, node_hash, parent_hash, subtree) AS (
  SELECT depth, node_hash, parent_hash, node_hash FROM d WHERE depth = (SELECT max(depth) FROM d)
  UNION ALL
  SELECT d.depth, d.node_hash, d.parent_hash, CASE WHEN c.below IS NULL THEN d.node_hash ELSE sha256(unhex(d.node_hash) || unhex(c.below) || unhex(d.count_hex)) END
  FROM (SELECT max(depth) - 1 AS level FROM up) l JOIN d ON d.depth = l.level LEFT JOIN (SELECT parent_hash, string_agg(subtree, '' ORDER BY subtree) AS below FROM up GROUP BY 1) c ON c.parent_hash = d.node_hash
)"""
query("pm06_subtree_hashes", T.replace("WITH e", "WITH RECURSIVE e") + UP + " SELECT node_hash, subtree FROM up")(lambda s, d: tree.subtree_hashes(log(s, d), 4))
query("pm07_fingerprint", T.replace("WITH e", "WITH RECURSIVE e") + UP + " SELECT subtree AS fingerprint FROM up WHERE depth = 0")(lambda s, d: tree.fingerprint(log(s, d), 4))
#: All nodes of the tree, whatever its depth.
DEEP = E.replace("WITH e", "WITH RECURSIVE e") + """, tr AS (SELECT case_id, list(activity ORDER BY timestamp, seq) AS p FROM e GROUP BY case_id),
walk(case_id, depth, activity, node_hash, parent_hash) AS (
  SELECT case_id, 1, p[1], sha256(encode(p[1]) || unhex(sha256('__ROOT__'))), sha256('__ROOT__') FROM tr
  UNION ALL
  SELECT w.case_id, w.depth + 1, t.p[w.depth + 1], sha256(encode(t.p[w.depth + 1]) || unhex(w.node_hash)), w.node_hash FROM walk w JOIN tr t ON t.case_id = w.case_id WHERE w.depth < len(t.p)
), n AS (SELECT depth, activity, node_hash, parent_hash, count(*) AS case_count FROM walk GROUP BY 1, 2, 3, 4)"""
query("pm05_all_nodes", DEEP + " SELECT depth, activity, node_hash, parent_hash, case_count FROM n")(lambda s, d: tree.nodes(log(s, d)).drop("avg_duration"))
query("pm06_all_subtree_hashes", DEEP + UP + " SELECT node_hash, subtree FROM up")(lambda s, d: tree.subtree_hashes(log(s, d)))
query("pm07_whole_fingerprint", DEEP + UP + " SELECT subtree AS fingerprint FROM up WHERE depth = 0")(lambda s, d: tree.fingerprint(log(s, d)))


@query("snk13_tree_manifest", T + " SELECT depth, activity, node_hash, parent_hash, case_count FROM n")
def _manifest(s, d) -> DataFrame:
    from eventloom.session import scratch

    path = scratch(s, "manifest")
    tree.write_manifest(log(s, d), path, 4)
    return tree.read_manifest(s, path).drop("avg_duration")


query("snk13_tree_binary", T + " SELECT depth, activity, node_hash, parent_hash, case_count FROM n")(lambda s, d: tree.decode_nodes(tree.encode_nodes(tree.nodes(log(s, d), 4))).drop("avg_duration"))
query("snk13_tree_footer", T + " SELECT depth, activity, node_hash, parent_hash, case_count FROM n")(
    lambda s, d: tree.decode_nodes(tree.encode_nodes(tree.nodes(log(s, d), 4)).select(F.base64("node").alias("footer")).select(F.unbase64("footer").alias("node"))).drop("avg_duration")
)
query("pm10_tree_stats", E + ", t AS (SELECT list(activity ORDER BY timestamp, seq) AS p FROM e GROUP BY case_id), n AS (SELECT DISTINCT p[1:k] AS path, k FROM (SELECT p, unnest(range(1, len(p) + 1)) AS k FROM t)) SELECT (SELECT count(*) FROM n) AS n_nodes, (SELECT CAST(max(k) AS INTEGER) FROM n) AS max_depth, (SELECT count(*) FROM e) AS n_events, (SELECT count(*) FROM t) AS n_cases, (SELECT count(*) FROM n WHERE path NOT IN (SELECT path[1:k - 1] FROM n)) AS n_leaves")(
    lambda s, d: tree.stats(log(s, d))
)


HALVES = T.replace("FROM events\n", "FROM events WHERE user_id % 2 = 0\n").replace("WITH e AS", "WITH e AS") + """, ln AS (SELECT node_hash, activity, depth, round(case_count / (SELECT count(*) FROM tr)::DOUBLE, 9) AS left_share, avg_duration AS ld FROM n),
e2 AS (SELECT CAST(user_id AS VARCHAR) AS case_id, event_type AS activity, epoch_us(ts) * 1000 AS timestamp, event_id AS seq FROM events WHERE user_id % 2 = 1),
tr2 AS (SELECT case_id, list(activity ORDER BY timestamp, seq)[1:4] AS p, list(timestamp ORDER BY timestamp, seq) AS t FROM e2 GROUP BY case_id),
g1 AS (SELECT case_id, 1 AS depth, p[1] AS activity, sha256(encode(p[1]) || unhex(sha256('__ROOT__'))) AS node_hash, t[2] - t[1] AS duration FROM tr2 WHERE len(p) >= 1),
g2 AS (SELECT tr2.case_id, 2 AS depth, p[2] AS activity, sha256(encode(p[2]) || unhex(g1.node_hash)) AS node_hash, t[3] - t[2] AS duration FROM tr2 JOIN g1 USING (case_id) WHERE len(p) >= 2),
g3 AS (SELECT tr2.case_id, 3 AS depth, p[3] AS activity, sha256(encode(p[3]) || unhex(g2.node_hash)) AS node_hash, t[4] - t[3] AS duration FROM tr2 JOIN g2 USING (case_id) WHERE len(p) >= 3),
g4 AS (SELECT tr2.case_id, 4 AS depth, p[4] AS activity, sha256(encode(p[4]) || unhex(g3.node_hash)) AS node_hash, t[5] - t[4] AS duration FROM tr2 JOIN g3 USING (case_id) WHERE len(p) >= 4),
rn AS (SELECT node_hash, activity, depth, round(count(*) / (SELECT count(*) FROM tr2)::DOUBLE, 9) AS right_share, round(avg(duration), 3) AS rd FROM (SELECT * FROM g1 UNION ALL SELECT * FROM g2 UNION ALL SELECT * FROM g3 UNION ALL SELECT * FROM g4) x GROUP BY 1, 2, 3)"""


@query("pm11_tree_diff", HALVES + """
SELECT node_hash, activity, depth, left_share, right_share, CASE WHEN left_share IS NULL THEN 'new' WHEN right_share IS NULL THEN 'removed' WHEN abs(right_share - left_share) > 0.01 THEN 'frequency' WHEN ld > 0 AND rd > 0 AND abs(rd - ld) / ld > 0.1 THEN 'duration' ELSE 'same' END AS status
FROM ln FULL JOIN rn USING (node_hash, activity, depth)""")
def _tree_diff(s, d) -> DataFrame:
    e = log(s, d)
    return tree.compare(e.where("cast(case_id as long) % 2 = 0"), e.where("cast(case_id as long) % 2 = 1"), max_depth=4)


query("jn09_shared_nodes", HALVES + " SELECT ln.node_hash, ln.activity FROM ln JOIN rn USING (node_hash)")(lambda s, d: (lambda e: tree.nodes(e.where("cast(case_id as long) % 2 = 0"), 4).select("node_hash", "activity").join(tree.nodes(e.where("cast(case_id as long) % 2 = 1"), 4).select("node_hash"), "node_hash"))(log(s, d)))
query("ag21_tree_objects", T + ", v AS (SELECT case_id, node_hash FROM h1 UNION ALL SELECT case_id, node_hash FROM h2 UNION ALL SELECT case_id, node_hash FROM h3 UNION ALL SELECT case_id, node_hash FROM h4), o AS (SELECT DISTINCT case_id, 'resource' AS object_type, resource AS object_id FROM e WHERE resource IS NOT NULL UNION SELECT DISTINCT case_id, 'day', strftime(ts, '%Y-%m-%d') FROM e) SELECT node_hash, object_type, count(DISTINCT object_id) AS n_objects, count(DISTINCT case_id) AS n_cases FROM v JOIN o USING (case_id) GROUP BY 1, 2")(
    lambda s, d: (lambda e: tree.object_counts(e, e.where("resource is not null").select("case_id", F.lit("resource").alias("object_type"), F.col("resource").alias("object_id")).unionByName(e.select("case_id", F.lit("day").alias("object_type"), F.date_format(as_timestamp("timestamp"), "yyyy-MM-dd").alias("object_id"))), 4))(log(s, d))
)


# differences of the log's two halves
def _halves(s, d) -> tuple[DataFrame, DataFrame]:
    e = log(s, d)
    return e.where("cast(case_id as long) % 2 = 0"), e.where("cast(case_id as long) % 2 = 1 and activity <> 'error'")


H = E + ", a AS (SELECT * FROM e WHERE CAST(case_id AS BIGINT) % 2 = 0), b AS (SELECT * FROM e WHERE CAST(case_id AS BIGINT) % 2 = 1 AND activity <> 'error')"
STATUS = "CASE WHEN left_n = 0 THEN 'new' WHEN right_n = 0 THEN 'removed' WHEN abs(delta) < {} THEN 'stable' WHEN delta > 0 THEN 'increased' ELSE 'decreased' END AS status"
CHANGES = H + ", x AS (SELECT activity, coalesce(l.n, 0) AS left_n, coalesce(r.n, 0) AS right_n FROM (SELECT activity, count(*) AS n FROM a GROUP BY 1) l FULL JOIN (SELECT activity, count(*) AS n FROM b GROUP BY 1) r USING (activity)), y AS (SELECT *, left_n * 100.0::DOUBLE / sum(left_n) OVER () AS ls, right_n * 100.0::DOUBLE / sum(right_n) OVER () AS rs FROM x), z AS (SELECT activity, left_n, right_n, round(ls, 6) AS left_share, round(rs, 6) AS right_share, round(rs - ls, 6) AS delta FROM y)"
query("pm15_activity_changes", CHANGES + " SELECT *, " + STATUS.format("1.0") + " FROM z")(lambda s, d: diff.activity_changes(*_halves(s, d)))
query(
    "pm15_resource_changes",
    H
    + ", x AS (SELECT resource, coalesce(l.n, 0) AS left_n, coalesce(r.n, 0) AS right_n FROM (SELECT resource, count(*) AS n FROM a WHERE resource IS NOT NULL GROUP BY 1) l FULL JOIN (SELECT resource, count(*) AS n FROM b WHERE resource IS NOT NULL GROUP BY 1) r USING (resource)), z AS (SELECT *, round(CASE WHEN left_n = 0 THEN 100.0::DOUBLE ELSE (right_n - left_n) * 100.0::DOUBLE / left_n END, 6) AS delta FROM x) SELECT *, "
    + STATUS.format("5.0")
    + " FROM z",
)(lambda s, d: diff.resource_changes(*_halves(s, d)))
query("st03_largest_changes", CHANGES + " SELECT *, " + STATUS.format("1.0") + " FROM z ORDER BY abs(delta) DESC, activity LIMIT 3")(lambda s, d: diff.activity_changes(*_halves(s, d)).orderBy(F.abs("delta").desc(), "activity").limit(3))
query("jn07_merged_counts", H + " SELECT activity, coalesce(l.n, 0) AS left_n, coalesce(r.n, 0) AS right_n FROM (SELECT activity, count(*) AS n FROM a GROUP BY 1) l FULL JOIN (SELECT activity, count(*) AS n FROM b GROUP BY 1) r USING (activity)")(lambda s, d: diff.activity_changes(*_halves(s, d)).select("activity", "left_n", "right_n"))
query("jn08_only_in_one", H + " SELECT DISTINCT activity, 'left' AS side FROM a WHERE activity NOT IN (SELECT activity FROM b) UNION ALL SELECT DISTINCT activity, 'right' FROM b WHERE activity NOT IN (SELECT activity FROM a)")(lambda s, d: diff.only_in(*_halves(s, d)))
query("so02_key_union", H + " SELECT activity FROM a UNION SELECT activity FROM b")(lambda s, d: (lambda x, y: x.select("activity").unionByName(y.select("activity")).distinct())(*_halves(s, d)))
query("so01_except_cases", E + " SELECT case_id FROM e WHERE activity = 'purchase' EXCEPT SELECT case_id FROM e WHERE activity = 'error' AND resource = 'r1'")(lambda s, d: (lambda e: e.where("activity = 'purchase'").select("case_id").subtract(e.where("activity = 'error' and resource = 'r1'").select("case_id")))(log(s, d)))
SIDE = "SELECT '{0}' AS side, CAST(sum(n) AS BIGINT) AS n_events, count(*) AS n_cases, min(a) AS first_ts, max(b) AS last_ts, CAST(sum(b - a) // count(*) AS BIGINT) AS avg_duration FROM (SELECT count(*) AS n, min(timestamp) AS a, max(timestamp) AS b FROM {1} WHERE timestamp > 0 GROUP BY case_id) t"
query("pm15_summary", H + " " + SIDE.format("left", "a") + " UNION ALL " + SIDE.format("right", "b"))(lambda s, d: diff.summary(*_halves(s, d)))
REPORT = CHANGES + ", t AS (SELECT *, " + STATUS.format("1.0") + " FROM z), s AS (" + SIDE.format("left", "a") + " UNION ALL " + SIDE.format("right", "b") + ") SELECT side || ': ' || n_events || ' events, ' || n_cases || ' cases, average duration ' || avg_duration || ' ns' AS line FROM s UNION ALL SELECT line FROM (SELECT printf('%s %s: %.2f%% -> %.2f%%', status, activity, left_share, right_share) AS line FROM t WHERE status <> 'stable' ORDER BY abs(delta) DESC, activity LIMIT 20)"
query("pm16_text_report", REPORT)(lambda s, d: s.createDataFrame([(x,) for x in diff.text_report(*_halves(s, d)).splitlines()], "line string"))
query(
    "pm14_hybrid_diff",
    H + ", ends AS (SELECT 'time range' AS kind, 'first event' AS name, CAST((SELECT min(timestamp) FROM a) AS DOUBLE) AS left_value, CAST((SELECT min(timestamp) FROM b) AS DOUBLE) AS right_value UNION ALL SELECT 'time range', 'last event', CAST((SELECT max(timestamp) FROM a) AS DOUBLE), CAST((SELECT max(timestamp) FROM b) AS DOUBLE)), li AS (SELECT activity, coalesce(lead(timestamp) OVER (PARTITION BY case_id ORDER BY timestamp, seq), timestamp) - timestamp AS t FROM a), ri AS (SELECT activity, coalesce(lead(timestamp) OVER (PARTITION BY case_id ORDER BY timestamp, seq), timestamp) - timestamp AS t FROM b), ls AS (SELECT activity AS name, avg(t) AS left_value FROM li GROUP BY 1), rs AS (SELECT activity AS name, avg(t) AS right_value FROM ri GROUP BY 1) SELECT * FROM ends WHERE left_value <> right_value UNION ALL SELECT 'bottleneck', name, coalesce(round(left_value, 0), -1), coalesce(round(right_value, 0), -1) FROM ls FULL JOIN rs USING (name) WHERE left_value IS NULL OR right_value IS NULL OR abs(right_value - left_value) > 0.02 * left_value",
)(lambda s, d: diff.hybrid(*_halves(s, d), change=0.02).where("kind <> 'nodes'").select("kind", "name", *[F.when(F.col("kind") == "bottleneck", F.coalesce(F.round(c), F.lit(-1.0))).otherwise(F.col(c)).alias(c) for c in ("left_value", "right_value")]))
query("pm14_hybrid_nodes", HALVES + " SELECT CASE WHEN left_share IS NULL THEN 'new' WHEN right_share IS NULL THEN 'removed' WHEN abs(right_share - left_share) > 0.01 THEN 'frequency' WHEN ld > 0 AND rd > 0 AND abs(rd - ld) / ld > 0.1 THEN 'duration' ELSE 'same' END AS name, CAST(count(*) AS DOUBLE) AS n FROM ln FULL JOIN rn USING (node_hash, activity, depth) GROUP BY 1")(
    lambda s, d: (lambda e: diff.hybrid(e.where("cast(case_id as long) % 2 = 0"), e.where("cast(case_id as long) % 2 = 1"), max_depth=4))(log(s, d)).where("kind = 'nodes'").select("name", F.col("right_value").alias("n"))
)

# intervals
P = I + ", p AS (SELECT * FROM iv WHERE \"start\" >= {0} AND \"start\" < {1})".format(FIRST, FIRST + 2 * DAY)


def _spans(s, d) -> DataFrame:
    return mining.intervals(log(s, d)).where((F.col("start") >= FIRST) & (F.col("start") < FIRST + 2 * DAY))


query(
    "jn10_activity_overlaps",
    I + ' SELECT a.seq AS l_seq, b.seq AS r_seq, greatest(a."start", b."start") AS overlap_start, least(a."end", b."end") AS overlap_end FROM iv a JOIN iv b ON a.activity = \'view\' AND b.activity = \'click\' AND a."start" < b."end" AND b."start" < a."end" WHERE least(a."end", b."end") > greatest(a."start", b."start")',
)(lambda s, d: intervals.activity_overlaps(mining.intervals(log(s, d)), "view", "click").select("l_seq", "r_seq", "overlap_start", "overlap_end"))
query(
    "jn11_concurrent",
    P + ' SELECT a.activity AS l_activity, b.activity AS r_activity, count(*) AS n FROM p a JOIN p b ON a.seq < b.seq AND a."start" < b."end" AND b."start" < a."end" WHERE least(a."end", b."end") > greatest(a."start", b."start") AND a."start" <= {1} AND a."end" >= {0} AND b."start" <= {1} AND b."end" >= {0} GROUP BY 1, 2'.format(FIRST + DAY, FIRST + DAY + DAY // 2),
)(lambda s, d: intervals.concurrent_counts(_spans(s, d), FIRST + DAY, FIRST + DAY + DAY // 2))
query("jn12_stabbing", I + f' SELECT seq, activity FROM iv WHERE "start" <= {FIRST + DAY} AND "end" >= {FIRST + DAY}')(lambda s, d: intervals.stab(mining.intervals(log(s, d)), FIRST + DAY, FIRST + DAY).select("seq", "activity"))
query(
    "jn13_as_of",
    E + ", v AS (SELECT case_id, timestamp AS t, value AS signup_value FROM e WHERE activity = 'signup'), p AS (SELECT * FROM e WHERE activity = 'purchase') SELECT p.seq, v.signup_value FROM p ASOF LEFT JOIN v ON p.case_id = v.case_id AND p.timestamp >= v.t",
)(
    lambda s, d: (lambda e: intervals.as_of(e.where("activity = 'purchase'").select("case_id", "seq", "timestamp"), e.where("activity = 'signup'").select("case_id", "seq", "timestamp", F.col("value").alias("signup_value")), ["case_id"], "timestamp", "timestamp", ["signup_value"], "seq").select("seq", "signup_value"))(log(s, d, ["value"]))
)
query("wn10_latest_version", E + f" SELECT case_id, arg_max(value, timestamp) AS value FROM e WHERE timestamp <= {FIRST + 10 * DAY} GROUP BY case_id")(lambda s, d: intervals.value_at(log(s, d, ["value"]), ["case_id"], "timestamp", "value", FIRST + 10 * DAY))
query("pm14_hybrid_stats", I + ' SELECT count(*) AS n_intervals, min("start") AS first_ts, max("end") AS last_ts, count(DISTINCT activity) AS n_activities FROM iv')(
    lambda s, d: mining.intervals(log(s, d)).agg(F.count(F.lit(1)).alias("n_intervals"), F.min("start").alias("first_ts"), F.max("end").alias("last_ts"), F.countDistinct("activity").alias("n_activities"))
)

# star schema
SS = (
    E
    + """, dc AS (SELECT case_id, min(timestamp) AS start_ts, max(timestamp) AS end_ts, count(*) AS event_count, round((max(timestamp) - min(timestamp)) / 1e9, 6) AS duration_seconds, CAST(row_number() OVER (ORDER BY case_id) AS INTEGER) AS case_key FROM e GROUP BY case_id),
da AS (SELECT activity AS activity_name, count(*) AS occurrence_count, CAST(row_number() OVER (ORDER BY activity) AS INTEGER) AS activity_key FROM e GROUP BY activity),
dr AS (SELECT coalesce(resource, 'Unknown') AS resource_name, count(*) AS event_count, CAST(row_number() OVER (ORDER BY coalesce(resource, 'Unknown')) AS INTEGER) AS resource_key FROM e GROUP BY 1),
dt AS (SELECT date, CAST(year(date) AS INTEGER) AS year, CAST(quarter(date) AS INTEGER) AS quarter, CAST(month(date) AS INTEGER) AS month, CAST(day(date) AS INTEGER) AS day, CAST(dayofweek(date) AS INTEGER) AS day_of_week, CAST(weekofyear(date) AS INTEGER) AS week, dayofweek(date) IN (0, 6) AS is_weekend, 'Q' || quarter(date) AS quarter_name, monthname(date) AS month_name, CAST(row_number() OVER (ORDER BY date) AS INTEGER) AS time_key FROM (SELECT DISTINCT CAST(ts AS DATE) AS date FROM e))"""
)
query("ss01_dim_cases", SS + " SELECT * FROM dc")(lambda s, d: star.dim_cases(log(s, d)))
query("ss02_dim_activities", SS + " SELECT * FROM da")(lambda s, d: star.dim_activities(log(s, d)))
query("ss03_dim_resources", SS + " SELECT * FROM dr")(lambda s, d: star.dim_resources(log(s, d)))
query("ss04_dim_time", SS + " SELECT * REPLACE (CAST(date AS VARCHAR) AS date) FROM dt")(lambda s, d: star.dim_time(log(s, d)).withColumn("date", F.col("date").cast("string")))
query(
    "ss05_fact_events",
    SS + " SELECT seq, case_key, activity_key, resource_key, time_key, timestamp, coalesce(lag(timestamp) OVER w, -1) AS previous_ts, timestamp - coalesce(lag(timestamp) OVER w, timestamp) AS since_previous FROM e JOIN dc USING (case_id) JOIN da ON activity = activity_name JOIN dr ON coalesce(resource, 'Unknown') = resource_name JOIN dt ON CAST(ts AS DATE) = date WINDOW w AS (PARTITION BY case_id ORDER BY timestamp, seq)",
)(lambda s, d: star.fact_events(log(s, d)).withColumn("previous_ts", F.coalesce("previous_ts", F.lit(-1))))


query("wn06_fact_key", SS + " SELECT seq, row_number() OVER (ORDER BY seq) AS fact_key, case_key FROM e JOIN dc USING (case_id)")(lambda s, d: star.with_fact_key(star.fact_events(log(s, d))).select("seq", "fact_key", "case_key"))


@query("ss06_export", SS + " SELECT 'dim_cases' AS name, count(*) AS n FROM dc UNION ALL SELECT 'dim_activities', count(*) FROM da UNION ALL SELECT 'dim_resources', count(*) FROM dr UNION ALL SELECT 'dim_time', count(*) FROM dt UNION ALL SELECT 'fact_events', count(*) FROM e")
def _export(s, d) -> DataFrame:
    from eventloom.session import scratch

    paths = star.export(log(s, d), scratch(s, "star"))
    parts = [s.read.parquet(p).agg(F.count(F.lit(1)).alias("n")).select(F.lit(p.rsplit("/", 1)[-1]).alias("name"), "n") for p in paths]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
