"""Operators on hand-made logs with known answers and edge cases."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventloom import log as logs
from eventloom.operators import diff, filters, healing, intervals, mining, privacy, quality, schemas, tree
from eventloom.operators import ocel as oc
from eventloom.sources import detect, readers
from eventloom.streaming import streams

EVENTS = "case_id string, activity string, timestamp long, resource string, seq long"


def log(spark, rows):
    return spark.createDataFrame(rows, EVENTS)


@pytest.fixture(scope="module")
def small(spark):
    return log(spark, [("a", "x", 10, "r", 1), ("a", "y", 10, None, 2), ("a", "z", 30, "s", 3), ("b", "x", 5, "r", 4), ("b", "y", 7, "r", 5), ("c", "q", 0, "", 6)])


def test_ties_follow_seq(small):
    assert {(r.activity, r.next_activity): r.edge_count for r in mining.dfg(small).collect()} == {("x", "y"): 2, ("y", "z"): 1}


def test_empty_log(spark):
    empty = log(spark, [])
    assert mining.dfg(empty).count() == 0
    assert mining.variants(empty).count() == 0
    assert mining.duplicates(empty).first().n_duplicates == 0
    assert tree.nodes(empty).count() == 0


def test_single_event_case_starts_and_ends(small):
    assert {r.activity: (r.n_starts, r.n_ends) for r in mining.ends(small).collect()}["q"] == (1, 1)


def test_intervals_end_at_the_next_event(small):
    assert {r.seq: (r.start, r.end) for r in mining.intervals(small).collect()}[2] == (10, 30)


def test_out_of_order_counts_arrivals(spark):
    rows = [("a", "x", t, None, i) for i, t in enumerate([5, 3, 0, 4, 10, 9])]
    assert mining.out_of_order(log(spark, rows)).first().n_out_of_order == 2


def test_prefix_case_is_no_leaf(small):
    found = tree.nodes(small)
    assert {(r.activity, r.case_count) for r in tree.leaves(found).collect()} == {("z", 1), ("q", 1)}
    root = hashlib.sha256(b"__ROOT__").digest()
    assert found.where("activity = 'q'").first().node_hash == hashlib.sha256(b"q" + root).hexdigest()


def test_subtree_hashes_match_recursion(small):
    found = {r.node_hash: r for r in tree.nodes(small).collect()}
    root = hashlib.sha256(b"__ROOT__").hexdigest()

    def subtree(node: str, count: int) -> str:
        children = sorted(subtree(h, r.case_count) for h, r in found.items() if r.parent_hash == node)
        return node if not children else hashlib.sha256(bytes.fromhex(node) + b"".join(map(bytes.fromhex, children)) + count.to_bytes(8, "little")).hexdigest()

    total = sum(r.case_count for r in found.values() if r.depth == 1)
    assert tree.fingerprint(small).first().fingerprint == subtree(root, total)


def test_equal_logs_have_equal_trees(small):
    assert {r.status for r in tree.compare(small, small).collect()} == {"same"}
    assert tree.fingerprint(small).first() == tree.fingerprint(small.orderBy(F.desc("seq"))).first()


def test_touching_intervals_do_not_overlap(spark):
    spans = spark.createDataFrame([("v", 1, 0, 10), ("w", 2, 10, 20), ("w", 3, 5, 6)], "activity string, seq long, start long, end long")
    assert [(r.l_seq, r.r_seq) for r in intervals.activity_overlaps(spans, "v", "w").collect()] == [(1, 3)]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 30)), min_size=1, max_size=12), st.integers(1, 20))
def test_overlaps_match_all_pairs(spark, spans, width):
    rows = [("v", i, a, a + n) for i, (a, n) in enumerate(spans)]
    df = spark.createDataFrame(rows, "activity string, seq long, start long, end long")
    found = sorted((r.l_seq, r.r_seq) for r in intervals.overlaps(df, df, width=width).collect())
    assert found == sorted((i, j) for _, i, a, b in rows for _, j, c, d in rows if min(b, d) > max(a, c) and a < d and c < b)


def test_as_of_takes_the_version_at_the_instant(spark):
    left = spark.createDataFrame([("k", 5), ("k", 4), ("j", 9)], "k string, t long")
    right = spark.createDataFrame([("k", 5, "new"), ("k", 1, "old")], "k string, at long, v string")
    assert {(r.k, r.t, r.v) for r in intervals.as_of(left, right, ["k"], "t", "at", ["v"]).collect()} == {("k", 5, "new"), ("k", 4, "old"), ("j", 9, None)}


def test_left_and_right_only_activities(spark, small):
    other = log(spark, [("a", "x", 1, None, 1), ("a", "new", 2, None, 2)])
    assert {r.activity: r.status for r in diff.activity_changes(small, other).collect()}["new"] == "new"
    assert {(r.activity, r.side) for r in diff.only_in(small, other).collect()} == {("y", "left"), ("z", "left"), ("q", "left"), ("new", "right")}


def test_roles_are_found_by_exact_name_first():
    assert logs.detect_roles(["my_case", "case_id", "Activity", "when_timestamp"]) == {"case_id": "case_id", "activity": "Activity", "timestamp": "when_timestamp"}


def test_filters_say_what_they_cannot_do(spark):
    assert filters.condition("a", "in", []) is None
    assert filters.condition("a", "between", [1]) is None
    with pytest.raises(ValueError):
        filters.condition("a", "near", 1)


def test_dedup_error_strategy_fails_on_repeats(spark):
    df = spark.createDataFrame([(1, 1), (1, 2)], "k int, o int")
    with pytest.raises(Exception, match="repeated key"):
        privacy.deduplicate(df, ["k"], "o", "error").collect()
    assert privacy.deduplicate(df, ["k"], "o", "replace").first().o == 2


def test_pseudonyms_above_nine_are_decimal(spark):
    df = spark.createDataFrame([(f"v{i:02d}",) for i in range(12)] + [(None,), ("",)], "x string")
    assert {"P12", None, ""} <= {r.x for r in privacy.pseudonymise(df, {"x": "P"}).collect()}


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(alphabet='ab,;"\\ &\r\x00', max_size=12), min_size=1, max_size=8))
def test_healing_settles(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rules = ("encoding", "nul", "newlines", "quotes", "whitespace")
    once = df.select(healing.heal("t", rules=rules).alias("t"))
    assert [r.t for r in once.select(healing.heal("t", rules=rules).alias("t")).collect()] == [r.t for r in once.collect()]


def test_schema_policies(spark):
    a, b = spark.createDataFrame([], "x int, y string").schema, spark.createDataFrame([], "x bigint, y string, z double").schema
    assert schemas.merge(a, b, "merge_nullable").simpleString() == "struct<x:bigint,y:string,z:double>"
    with pytest.raises(ValueError):
        schemas.merge(a, b)
    with pytest.raises(ValueError):
        schemas.merge(b, a, "merge_nullable")
    assert not schemas.compatible(b, a)


def test_contract_finds_missing_columns(spark):
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    promise = quality.make_contract(df, "t", min_rows=1)
    assert quality.violations(df, promise) == []
    assert quality.violations(df.drop("y"), promise) == ["error: column y is missing"]


def test_integrity_names_what_is_missing(spark):
    events = spark.createDataFrame([("e", "t", None)], oc.EVENT)
    objects = spark.createDataFrame([("o", "k")], oc.OBJECT)
    relations = spark.createDataFrame([("e", "o", "q"), ("e", "p", "q"), ("f", "o", "q")], oc.EVENT_OBJECT)
    assert {(r.kind, r.id) for r in oc.violations(oc.Ocel(events, objects, relations)).collect()} == {("relation without object", "p"), ("relation without event", "f")}


def test_unnest_keeps_events_without_objects_only_if_told(spark):
    df = oc.with_objects(spark.createDataFrame([(1, "a"), (2, None), (3, "")], "n int, order_id string"))
    assert oc.unnested(df).count() == 1
    assert oc.unnested(df, outer=True).count() == 3


def test_detectors():
    assert detect.delimiter('a,"b;c",d\n1,"2;3",4\n') == ","
    assert detect.odd_quotes('a,"b')
    assert detect.ragged("a,b\n1\n2,3\n", ",")
    assert detect.encoding("é".encode()[:1] and b"abc\xc3") == "utf-8"


def test_xlsx_log(spark, tmp_path):
    from eventloom.plans.io_queries import workbook_bytes

    path = tmp_path / "log.xlsx"
    path.write_bytes(workbook_bytes([["case", "activity", "time"], ["1", "a", "45292.5"], ["1", "b", "2024-01-02"]]))
    rows = readers.xlsx(spark, str(path), "case", "activity", "time").orderBy("timestamp").collect()
    assert [(r.case_id, r.activity, r.timestamp) for r in rows] == [("1", "a", 1704110400 * 10**9), ("1", "b", 1704153600 * 10**9)]


def test_fnv_of_known_bytes():
    assert quality.fnv64a(b"") == 0xCBF29CE484222325
    assert quality.fnv64a(b"a") == 0xAF63DC4C8601EC8C


def test_one_long_interval_changes_no_pair(spark):
    rows = [("v", 0, 0, 10**9)] + [("v", i, i * 10, i * 10 + i % 7) for i in range(1, 60)]
    df = spark.createDataFrame(rows, "activity string, seq long, start long, end long")
    found = sorted((r.l_seq, r.r_seq) for r in intervals.overlaps(df, df).collect())
    assert found == sorted((i, j) for _, i, a, b in rows for _, j, c, d in rows if min(b, d) > max(a, c) and a < d and c < b)


def test_numbers_have_no_gaps(spark):
    from eventloom.operators.numbering import numbered

    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("v")).repartition(7)
    out = numbered(df, ["v"], "n").orderBy("n").collect()
    assert [r.n for r in out] == list(range(1, 1001)) and [r.v for r in out] == sorted(r.v for r in out)
    assert numbered(df.limit(0), ["v"], "n").count() == 0


def test_long_cases_have_the_hashes_of_a_plain_walk(spark):
    rows = [("a", f"s{i % 5}", i, None, i) for i in range(300)] + [("b", f"s{i % 5}", i, None, i) for i in range(130)] + [("b", "end", 500, None, 500)]
    found = tree.visits(log(spark, rows)).collect()
    for case in "ab":
        last = hashlib.sha256(b"__ROOT__").hexdigest()
        mine = sorted((r for r in found if r.case_id == case), key=lambda r: r.depth)
        for r, (_, activity, *_) in zip(mine, [x for x in rows if x[0] == case], strict=True):
            assert r.parent_hash == last and r.activity == activity
            last = hashlib.sha256(activity.encode() + bytes.fromhex(last)).hexdigest()
            assert r.node_hash == last


def test_plain_identifiers_are_found_as_cases():
    assert logs.detect_roles(["OrderID", "step", "at_time"])["case_id"] == "OrderID"
    assert logs.detect_roles(["id", "step", "ts"])["case_id"] == "id"


def test_arrow_files_are_for_small_results(spark, tmp_path):
    import pyarrow as pa

    from eventloom.sources import sinks

    path = str(tmp_path / "small.arrow")
    assert sinks.write_arrow(spark.range(20).toDF("n"), path) == 20
    assert pa.ipc.open_file(path).read_all().column("n").to_pylist() == list(range(20))
    with pytest.raises(ValueError):
        sinks.write_arrow(spark.range(20).toDF("n"), path, most_rows=19)


def test_catalogue_refuses_what_it_should(spark, tmp_path):
    from eventloom.operators.maintenance import Catalogue

    store = Catalogue(spark, str(tmp_path / "store"))
    store.create_database("d")
    store.create_table("d", "t", spark.range(3).toDF("n"))
    for wrong in (lambda: store.create_database("d"), lambda: store.create_table("d", "t", spark.range(1)), lambda: store.create_table("none", "t", spark.range(1)), lambda: store.drop_database("d"), lambda: store.drop_table("d.none")):
        with pytest.raises(ValueError):
            wrong()
    store.drop_table("d.t")
    store.create_table("d", "t", spark.range(5).toDF("n"))
    assert store.read("d.t").count() == 5 and store.read("d.t", 1).count() == 3


def test_a_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace

    from eventloom import session

    unset = SimpleNamespace(get=lambda *_: None)
    never = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="spark://host:7077", getConf=lambda: unset, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: never)))
    with pytest.raises(RuntimeError):
        session.shared_folder(SimpleNamespace(conf=unset, sparkContext=context))


def test_a_token_bucket_waits_for_what_is_over_its_burst():
    from eventloom.plans.ingest import Pace

    now, waited = [0.0], []
    pace = Pace(10, 20, clock=lambda: now[0], wait=waited.append)
    pace(20)
    pace(10)
    now[0] = 4.0
    pace(5)
    assert waited == [1.0]


def test_a_watched_folder_is_rebuilt_when_it_rests(spark, tmp_path):
    from eventloom.plans.ingest import watch

    built = []
    (tmp_path / "a.csv").write_text("x")

    def rebuild(files):
        built.append(sorted(f.path.rsplit("/", 1)[-1] for f in files if not f.path.endswith(".crc")))
        if len(built) == 1:
            (tmp_path / "b.csv").write_text("y")

    assert watch(spark, str(tmp_path), rebuild, quiet=0.2, poll=0.02, stop=lambda: len(built) == 2) == 2
    assert built == [["a.csv"], ["a.csv", "b.csv"]]


#: Twelve cases of 30 years: their lengths in nanoseconds add up to more than a long holds.
@pytest.fixture(scope="module")
def long_cases(spark):
    return log(spark, [(str(c), a, t, None, 2 * c + i) for c in range(12) for i, (a, t) in enumerate([("x", 1), ("y", 10**18)])])


def test_average_duration_of_a_sum_over_a_long(spark, long_cases):
    row = mining.average_duration(long_cases).first()
    assert (row.avg_duration, row.n_cases) == (10**18 - 1, 12)
    assert dict(mining.average_duration(long_cases).dtypes) == {"avg_duration": "bigint", "n_cases": "bigint"}
    assert mining.average_duration(log(spark, [])).first().avg_duration is None


def test_summary_of_durations_over_a_long(long_cases):
    assert {(r.side, r.n_events, r.n_cases, r.avg_duration) for r in diff.summary(long_cases, long_cases.where("case_id < '1'")).collect()} == {("left", 24, 12, 10**18 - 1), ("right", 2, 1, 10**18 - 1)}


def test_text_report_of_durations_over_a_long(long_cases):
    line = "24 events, 12 cases, average duration 999999999999999999 ns"
    assert diff.text_report(long_cases, long_cases) == f"left: {line}\nright: {line}"


def test_bottlenecks_with_a_total_over_a_long(long_cases):
    spans = mining.intervals(long_cases)
    found = mining.as_long(mining.bottlenecks(spans), "total_duration")
    assert dict(found.dtypes)["total_duration"] == "decimal(38,0)"
    assert [tuple(r) for r in found.collect()] == [("x", 12 * (10**18 - 1), 12, 10**18 - 1, 10**18 - 1), ("y", 0, 12, 0, 0)]
    assert dict(mining.as_long(mining.bottlenecks(spans.where("case_id < '1'")), "total_duration").dtypes)["total_duration"] == "bigint"


def test_bottlenecks_in_range_with_a_total_over_a_long(long_cases):
    found = mining.as_long(mining.bottlenecks(mining.intervals(long_cases), 2, 10**18 - 1, limit=3), "total_duration")
    assert [tuple(r) for r in found.collect()] == [("x", 12 * (10**18 - 1), 12, 10**18 - 1, 10**18 - 1)]


def test_sequence_bottlenecks_with_a_total_over_a_long(long_cases):
    found = mining.as_long(mining.sequence_bottlenecks(long_cases, ["x", "y"]), "total_duration")
    assert [tuple(r) for r in found.collect()] == [("x", 12 * (10**18 - 1), 12, 10**18 - 1, 10**18 - 1), ("y", 0, 12, 0, 0)]
    assert mining.as_long(mining.sequence_bottlenecks(long_cases, ["y", "x"]), "total_duration").count() == 0


def test_concurrent_pairs_are_counted_as_they_are_listed(spark, monkeypatch):
    made = random.Random(3)
    rows = [(made.choice(["x", "y", None]), made.randrange(50), t, t + made.randrange(12)) for t in (made.randrange(40) for _ in range(70))]
    spans = spark.createDataFrame(rows, "activity string, seq long, start long, end long")
    inside = [r for r in rows if r[2] <= 35 and r[3] >= 3]
    listed = Counter((a[0], b[0]) for a in inside for b in inside if a[1] < b[1] and min(a[3], b[3]) > max(a[2], b[2]))
    for counted in (intervals.COUNTED, 9):
        monkeypatch.setattr(intervals, "COUNTED", counted)
        assert {(r.l_activity, r.r_activity): r.n for r in intervals.concurrent_counts(spans, 3, 35).collect()} == listed
    assert intervals.concurrent_counts(spans.where("start > 100"), 3, 35).count() == 0


def test_crowded_cells_are_joined_by_blocks(spark, monkeypatch):
    rows = [(a, i, 10 + i % 3, 20 + i % 5) for i, a in enumerate("vw" * 30)]
    spans = spark.createDataFrame([*rows, ("w", 99, 0, 12)], "activity string, seq long, start long, end long")
    monkeypatch.setattr(intervals, "BLOCK", 4)
    found = intervals.activity_overlaps(spans, "v", "w")
    assert sorted((r.l_seq, r.r_seq) for r in found.collect()) == sorted([(v, w) for v in range(0, 60, 2) for w in range(1, 60, 2)] + [(v, 99) for v in range(0, 60, 2) if 10 + v % 3 < 12])
    a, b = intervals._in_blocks(intervals._in_cells(spans.where("activity = 'v'"), [16], "l"), intervals._in_cells(spans.where("activity = 'w'"), [16], "r"))
    assert max(r["count"] for x in (a, b) for r in x.groupBy("level", "cell", "l__block", "r__block").count().collect()) < 30


def test_concurrent_pairs_are_not_made(spark, data):
    from eventloom.plans import catalogue

    made, kept = [], intervals.overlaps
    intervals.overlaps = lambda *x, **y: made.append(x) or kept(*x, **y)
    try:
        catalogue.queries()["jn11_concurrent"](spark, data).count()
    finally:
        intervals.overlaps = kept
    assert made == []


def test_overlaps_of_the_whole_log(spark, data):
    from eventloom.plans import catalogue

    days = catalogue.queries()["jn10_activity_overlaps"](spark, data).agg(F.min("overlap_start"), F.max("overlap_start")).first()
    assert days[1] - days[0] > 20 * 86_400_000_000_000


def test_stream_orders_a_case_over_files_and_pieces(spark, tmp_path):
    rows = [(c, str(t), t, None, t) for t in range(12) for c in "ab"]
    for name, part in (("1", rows[16:]), ("2", rows[:8]), ("3", rows[8:16])):
        log(spark, part).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        stream = spark.readStream.schema(EVENTS).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        streams.run_available(streams.directly_follows(stream), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = sorted((r.case_id, int(r.activity), int(r.next_activity)) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert found == [(c, t, t + 1) for c in "ab" for t in range(11)]


def test_shuffles_of_objects_grow_with_the_input(spark, monkeypatch):
    from eventloom import session

    events = spark.createDataFrame([(f"e{i}", "pay" if i % 2 else "ship", None) for i in range(12)], oc.EVENT)
    relations = spark.createDataFrame([(f"e{i}", o, "q") for i in range(12) for o in ("o", "p")] * 2, oc.EVENT_OBJECT)
    objects = spark.createDataFrame([("o", "order"), ("p", "part"), ("p", "part")], oc.OBJECT)
    made = oc.Ocel(events.unionByName(events), objects, relations)
    assert session.shares(events, relations) == 4
    monkeypatch.setattr(session, "SHARE", 16 * 12)
    assert session.shares(events, relations) == 1 + 4
    assert session.shares(events.join(relations, "event_id")) == 4
    monkeypatch.setattr(session, "SHARE", 16)
    # copies of events, relations and objects count once
    assert {(r.object_type, r.activity): (r.frequency, r.n_starts, r.n_ends) for r in oc.oc_activities(made).collect()} == {(t, a): (6, int(a == "ship"), int(a == "pay")) for t in ("order", "part") for a in ("pay", "ship")}
    for found in (oc.project(made, "part"), oc.oc_dfg(made), oc.violations(made)):
        plan = found._jdf.queryExecution().toString()
        assert max(map(int, re.findall(r"hashpartitioning\([^)]*\)?[^)]*, (\d+)\), REPARTITION_BY_NUM", plan))) > 48
    assert oc.project(made, "part").count() == 12 and oc.violations(made).count() == 0


def test_xes_is_written_in_several_files_of_one_root(spark, data, monkeypatch):
    from pathlib import Path

    from eventloom.plans import catalogue, io_queries

    written, kept = [], io_queries.lines
    monkeypatch.setattr(io_queries, "lines", lambda *x: written.append(kept(*x)) or written[-1])
    assert catalogue.queries()["src13_xes"](spark, data).count() == spark.read.parquet(f"{data}/events.parquet").count()
    texts = [p.read_text() for p in Path(written[0].removeprefix("file:")).glob("part-*")]
    assert len(texts) == 4 and all((x.count("<log>"), x.count("</log>")) == (1, 1) for x in texts)


def test_object_log_as_json_is_compressed(spark, tmp_path):
    events = spark.createDataFrame([(f"e{i}", "pay", None) for i in range(20)], oc.EVENT)
    relations = spark.createDataFrame([(f"e{i}", "o", "q") for i in range(1, 20)] * 2, oc.EVENT_OBJECT)
    oc.write_json(oc.Ocel(events, spark.createDataFrame([("o", "order")], oc.OBJECT), relations), str(tmp_path))
    assert {p.suffix for p in tmp_path.glob("*/part-*")} == {".gz"}
    back = oc.read_json(spark, str(tmp_path))
    assert sorted(map(tuple, back.events.collect())) == sorted(map(tuple, events.collect()))
    assert sorted(map(tuple, back.event_object.collect())) == sorted(map(tuple, relations.collect()))
