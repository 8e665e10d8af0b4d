"""Prefix trees of activity sequences as a table of nodes, with Merkle hashes.

A node is a path from the root. Its hash is SHA-256(activity, hash of the parent), the root's
SHA-256("__ROOT__"). A case's prefixes are hashed in one fold over pieces of PIECE steps, so that no
growing array is copied at each step, and nodes are grouped by hash. Hashes of subtrees go up the
tree level by level only where cases share nodes; below, a case has the nodes to itself and
one fold over them does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.session import materialised, scratch

ROOT = "__ROOT__"
#: Steps that are folded into one array; levels between two cuts of the lineage.
PIECE, LEVELS = 64, 4


def _steps(log: DataFrame) -> DataFrame:
    """case_id and steps: (activity, duration to the next event or null), in order."""
    ordered = F.array_sort(F.collect_list(F.struct("timestamp", "seq", "activity")))
    cases = log.where("activity is not null").groupBy("case_id").agg(ordered.alias("e"))
    step = F.transform("e", lambda x, i: F.struct(x["activity"].alias("activity"), (F.get("e", i + 1)["timestamp"] - x["timestamp"]).alias("duration")))
    return cases.select("case_id", step.alias("steps"))


def node_hash(activity: Column, parent: Column) -> Column:
    """Hex SHA-256 of the activity's bytes and the parent's hash bytes."""
    return F.sha2(F.concat(F.encode(activity, "utf-8"), F.unhex(parent)), 256)


def _scan(items: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The states after each item of an array: step(state, item), from the state `start`."""
    pieces = F.transform(F.sequence(F.lit(0), F.call_function("div", F.size(items) - 1, F.lit(PIECE)).cast("int")), lambda k: F.slice(items, k * PIECE + 1, PIECE))

    def extend(done: Column, piece: Column) -> Column:
        states = F.aggregate(piece, F.array(done["last"]), lambda got, item: F.concat(got, F.array(step(F.element_at(got, -1), item))))
        # a lambda's argument is made once
        return F.get(F.transform(F.array(states), lambda x: F.struct(F.concat(done["parts"], F.array(F.slice(x, 2, PIECE))).alias("parts"), F.element_at(x, -1).alias("last"))), F.lit(0))

    none = F.filter(F.array(F.array(start)), lambda x: F.lit(False))
    scanned = F.aggregate(pieces, F.struct(none.alias("parts"), start.alias("last")), extend)
    return F.when(F.size(items) > 0, F.flatten(scanned["parts"]))


def visits(log: DataFrame, max_depth: int | None = None) -> DataFrame:
    """case_id, depth, activity, node_hash, parent_hash, duration: every case's visit of a node."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(ROOT).alias("activity"), _root().alias("node_hash"), F.lit("").alias("parent_hash"), F.lit(None).cast("long").alias("duration"))

    def extend(last: Column, step: Column) -> Column:
        return F.struct(
            (last["depth"] + 1).alias("depth"), step["activity"].alias("activity"), node_hash(step["activity"], last["node_hash"]).alias("node_hash"), last["node_hash"].alias("parent_hash"), step["duration"].alias("duration")
        )

    steps = _steps(log)
    if max_depth:
        steps = steps.withColumn("steps", F.slice("steps", 1, max_depth))
    walked = steps.select("case_id", _scan(F.col("steps"), start, extend).alias("path"))
    return walked.select("case_id", F.explode("path").alias("v")).select("case_id", "v.*")


def _root() -> Column:
    return F.sha2(F.lit(ROOT).cast("binary"), 256)


def nodes(log: DataFrame, max_depth: int | None = None) -> DataFrame:
    """depth, activity, node_hash, parent_hash, case_count, avg_duration (mean time to the successor over the visits that have one)."""
    return _nodes(visits(log, max_depth)).drop("some_case")


def _nodes(found: DataFrame) -> DataFrame:
    """The nodes of visits, with one of the cases that come by."""
    return found.groupBy("depth", "activity", "node_hash", "parent_hash").agg(F.count(F.lit(1)).alias("case_count"), F.round(F.avg("duration"), 3).alias("avg_duration"), F.min("case_id").alias("some_case"))


def object_counts(log: DataFrame, objects: DataFrame, max_depth: int | None = None) -> DataFrame:
    """node_hash, object_type, n_objects, n_cases: the distinct objects of the cases that come by a node, and those cases, from `objects` (case_id, object_type, object_id)."""
    seen = visits(log, max_depth).select("case_id", "node_hash").join(objects.select("case_id", "object_type", "object_id").distinct(), "case_id")
    return seen.groupBy("node_hash", "object_type").agg(F.countDistinct("object_id").alias("n_objects"), F.countDistinct("case_id").alias("n_cases"))


def write_manifest(log: DataFrame, path: str, max_depth: int | None = None) -> None:
    """The tree as gzipped JSON lines: a node a line, by depth, with its place under its parent."""
    nodes(log, max_depth).repartitionByRange("depth").sortWithinPartitions("depth", "parent_hash", "activity").write.mode("overwrite").option("compression", "gzip").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("depth int, activity string, node_hash string, parent_hash string, case_count long, avg_duration double").json(path)


def encode_nodes(found: DataFrame) -> DataFrame:
    """Nodes as bytes, a row each, for a compact binary file or a footer (base64 of them).

    Big-endian: depth (4 bytes), hash and parent's hash (32 each), cases (8), thousandths of the mean
    duration (8, -1 for none), length of the activity (4), the activity in UTF-8.
    """
    number = lambda c, digits: F.unhex(F.lpad(F.hex(c), digits, "0"))
    name = F.encode("activity", "utf-8")
    parent = F.unhex(F.when(F.col("parent_hash") == "", F.lit("0" * 64)).otherwise(F.col("parent_hash")))
    duration = F.unhex(F.lpad(F.hex(F.coalesce(F.round(F.col("avg_duration") * 1000).cast("long"), F.lit(-1))), 16, "0"))
    return found.select(F.concat(number(F.col("depth").cast("long"), 8), F.unhex("node_hash"), parent, number("case_count", 16), duration, number(F.octet_length(name).cast("long"), 8), name).alias("node"))


def decode_nodes(encoded: DataFrame) -> DataFrame:
    """What :func:`encode_nodes` made of nodes (mean durations to a thousandth)."""
    part = lambda at, n: F.substring("node", at, n)
    number = lambda at, n: F.conv(F.hex(part(at, n)), 16, -10).cast("long")
    parent = F.lower(F.hex(part(37, 32)))
    duration = number(77, 8)
    return encoded.select(
        number(1, 4).cast("int").alias("depth"),
        F.decode(F.expr("substring(node, 89)"), "utf-8").alias("activity"),
        F.lower(F.hex(part(5, 32))).alias("node_hash"),
        F.when(parent == "0" * 64, "").otherwise(parent).alias("parent_hash"),
        number(69, 8).alias("case_count"),
        F.when(duration >= 0, duration / 1000.0).alias("avg_duration"),
    )


def leaves(found: DataFrame) -> DataFrame:
    """Nodes without children: complete variants as far as no other case goes on from them."""
    return found.join(found.select(F.col("parent_hash").alias("p")).distinct(), found["node_hash"] == F.col("p"), "left_anti")


def has_path(log: DataFrame, path: list[str]) -> DataFrame:
    """One row, has_path: whether some case starts with the path; a semi-join on its node hash."""
    spark = log.sparkSession
    digest = _root()
    for activity in path:
        digest = node_hash(F.lit(activity), digest)
    found = nodes(log, len(path)).where((F.col("depth") == len(path)) & (F.col("node_hash") == digest))
    return found.agg((F.count(F.lit(1)) > 0).alias("has_path")) if path else spark.range(1).select(F.lit(True).alias("has_path"))


def stats(log: DataFrame) -> DataFrame:
    found = nodes(log)
    leaf = leaves(found).agg(F.count(F.lit(1)).alias("n_leaves"))
    base = found.agg(F.count(F.lit(1)).alias("n_nodes"), F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"), F.sum("case_count").alias("n_events"), F.sum(F.when(F.col("depth") == 1, F.col("case_count"))).alias("n_cases"))
    return base.withColumn("j", F.lit(1)).join(leaf.withColumn("j", F.lit(1)), "j").drop("j")


def subtree_hashes(log: DataFrame, max_depth: int | None = None) -> DataFrame:
    """node_hash and subtree: a leaf's own hash, else SHA-256(own hash, children's subtree hashes in order, little-endian count).

    Nodes of a single case are chains: each chain is folded from its leaf up in one expression.
    The nodes that cases share are gone through level by level from the deepest, each level an
    aggregate over its children; the nodes are written once, by level, and every LEVELS levels the
    lineage is cut.
    """
    spark = log.sparkSession
    path = scratch(spark, "tree")
    found = _nodes(visits(log, max_depth)).select("depth", "node_hash", "parent_hash", "case_count", "some_case")
    root = found.where("depth = 1").agg(F.sum("case_count").alias("case_count")).select(F.lit(0).alias("depth"), _root().alias("node_hash"), F.lit("").alias("parent_hash"), F.coalesce("case_count", F.lit(0)).alias("case_count"), F.lit(None).cast("string").alias("some_case"))
    found.unionByName(root).withColumn("level", F.when((F.col("case_count") > 1) | (F.col("depth") == 0), F.col("depth")).otherwise(-1)).write.partitionBy("level").parquet(path)
    kept = spark.read.parquet(path)
    chain = F.reverse(F.array_sort(F.collect_list(F.struct("depth", "node_hash", "parent_hash"))))
    chains = kept.where("level = -1").groupBy("some_case").agg(chain.alias("chain"))

    def up(below: Column, node: Column) -> Column:
        digest = F.sha2(F.concat(F.unhex(node["node_hash"]), F.unhex(below["subtree"]), _little_endian(F.lit(1).cast("long"))), 256)
        return F.struct(node["node_hash"].alias("node_hash"), node["parent_hash"].alias("parent_hash"), F.when(below["subtree"].isNull(), node["node_hash"]).otherwise(digest).alias("subtree"))

    nothing = F.struct(F.lit("").alias("node_hash"), F.lit("").alias("parent_hash"), F.lit(None).cast("string").alias("subtree"))
    alone = materialised(chains.select(F.explode(_scan(F.col("chain"), nothing, up)).alias("x")).select("x.*"))
    # the top of each chain hangs below a shared node
    shared = kept.where("level >= 0")
    level = tops = alone.join(shared.select(F.col("node_hash").alias("parent_hash")), "parent_hash", "left_semi")
    deepest = shared.agg(F.max("level")).first()[0]
    done = alone.select("node_hash", "subtree")
    for step, depth in enumerate(range(deepest, -1, -1)):
        below = tops if step == 0 else tops.unionByName(level)
        children = below.groupBy(F.col("parent_hash").alias("of")).agg(F.array_join(F.sort_array(F.collect_list("subtree")), "").alias("below"))
        joined = kept.where(F.col("level") == depth).join(children, F.col("node_hash") == F.col("of"), "left")
        digest = F.sha2(F.concat(F.unhex("node_hash"), F.unhex("below"), _little_endian(F.col("case_count"))), 256)
        level = joined.select("node_hash", "parent_hash", F.when(F.col("below").isNull(), F.col("node_hash")).otherwise(digest).alias("subtree"))
        if step % LEVELS == LEVELS - 1:
            level = materialised(level)
        done = done.unionByName(level.select("node_hash", "subtree"))
    return done


def _little_endian(column: Column) -> Column:
    """Eight bytes, the lowest first."""
    padded = F.lpad(F.hex(column), 16, "0")
    return F.unhex(F.concat(*[F.substring(padded, at, 2) for at in range(15, 0, -2)]))


def fingerprint(log: DataFrame, max_depth: int | None = None) -> DataFrame:
    """The root's subtree hash: equal for logs with the same tree (leaf counts are not hashed)."""
    return subtree_hashes(log, max_depth).where(F.col("node_hash") == _root()).select(F.col("subtree").alias("fingerprint"))


def compare(left: DataFrame, right: DataFrame, shift: float = 0.01, change: float = 0.1, max_depth: int | None = None) -> DataFrame:
    """Nodes of two logs: status new, removed, frequency (share moved by over `shift`), duration (mean changed by over `change`) or same."""

    def shares(log: DataFrame, side: str) -> DataFrame:
        found = nodes(log, max_depth)
        total = log.agg(F.countDistinct("case_id").alias("n")).withColumn("j", F.lit(1))
        return found.withColumn("j", F.lit(1)).join(total, "j").select("node_hash", "activity", "depth", F.round(F.col("case_count") / F.col("n"), 9).alias(f"{side}_share"), F.col("avg_duration").alias(f"{side}_duration"))

    both = shares(left, "left").join(shares(right, "right"), ["node_hash", "activity", "depth"], "full_outer")
    moved = F.abs(F.col("right_share") - F.col("left_share")) > shift
    slower = (F.col("left_duration") > 0) & (F.col("right_duration") > 0) & (F.abs(F.col("right_duration") - F.col("left_duration")) / F.col("left_duration") > change)
    status = F.when(F.col("left_share").isNull(), "new").when(F.col("right_share").isNull(), "removed").when(moved, "frequency").when(slower, "duration").otherwise("same")
    return both.select("node_hash", "activity", "depth", "left_share", "right_share", status.alias("status"))


def render(path: str | Column) -> Column:
    """A path as text: A -> B."""
    return F.array_join(F.col(path) if isinstance(path, str) else path, " -> ")
