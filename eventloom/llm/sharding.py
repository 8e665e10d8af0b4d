"""Sharding as a two-pass external shuffle, in DataFrame and SQL functions alone.

Pass one scatters records by seeded hashes: the shard by jump consistent hashing of the doc_id, the
bucket within the shard uniformly by a hash of the whole record, with as many buckets in a shard as
keep each within `bucket_rows` rows and `bucket_bytes` bytes of text on average. Pass two runs a
Fisher-Yates shuffle over each bucket: the swaps are drawn from a seeded hash of (shard, bucket,
step), so a retried task or another run gives the same permutation. Slots are gapless within a
shard: the buckets' sizes are summed in order, and a record's slot is its bucket's offset plus its
position.

Law `key`: doc_id and the number of shards decide the shard. When one shard is added, a record
either stays or goes to the new shard.

Skew: records of one doc_id (or none) share a shard, as the law has it, but not a bucket. Records
that are equal in all columns are counted first; of those with over MANY equals one is kept and made as
many times as it was counted, in pieces of PIECE, each copy with a number of its own, which
scatters it like other records. Only the small table of bucket sizes is summed in order, one task per shard.

Edge cases: a null text has size 1; rows with a null doc_id share one shard; rows that repeat a
doc_id share a shard and get slots of their own; very long texts count by their bytes when buckets are
sized; an empty table gives no rows. Extra columns of any type and name pass through, but input columns
named shard, slot or grown_shard are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from eventloom.llm.common import materialised, plainly_named, text_or_empty
from eventloom.llm.ranks import join_ranks, split_hot

#: Equal rows that may share a bucket; copies of one row that a task makes at once; rows with more equals that are broadcast.
MANY, PIECE, BROADCAST_TWINS = 256, 4096, 100_000


def jump_shard(key: Column, shards: int, seed: int = 17) -> Column:
    """Jump consistent hashing: step j = 1, 2, ... takes the key into shard j with probability 1 / (j + 1); the last step taken counts."""
    shard = F.lit(0)
    for j in range(1, shards):
        draw = F.shiftrightunsigned(F.xxhash64(key, F.lit(j), F.lit(seed)), 11).cast("double") / F.lit(float(1 << 53))
        shard = F.when(draw < 1.0 / (j + 1), F.lit(j)).otherwise(shard)
    return shard.cast("int")


def fisher_yates(size: Column, *salts: Column | int) -> Column:
    """A permutation of 0 .. size - 1: for i from the last position down, positions i and hash(i) mod (i + 1) are swapped."""
    keys = [s if isinstance(s, Column) else F.lit(s) for s in salts]

    def step(order: Column, i: Column) -> Column:
        j = F.pmod(F.xxhash64(i, *keys), i + 1).cast("int")
        return F.transform(order, lambda x, k: F.when(k == i, F.get(order, j)).when(k == j, F.get(order, i)).otherwise(x))

    start = F.sequence(F.lit(0), size - 1)
    steps = F.when(size > 1, F.sequence(size - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, start, step)


def _has_map(kind: DataType) -> bool:
    if isinstance(kind, ArrayType):
        return _has_map(kind.elementType)
    return isinstance(kind, MapType) or isinstance(kind, StructType) and any(_has_map(f.dataType) for f in kind)


def numbered_copies(docs: DataFrame) -> DataFrame:
    """`docs` with __same and __twin (two hashes of the whole row) and __copy (a number among equal rows, from 0; 0 for all where there are MANY at most)."""
    # maps cannot be hashed as they are
    content = [F.to_json(F.struct(F.col(f.name))) if _has_map(f.dataType) else F.col(f.name) for f in docs.schema]
    hashed = docs.withColumn("__same", F.xxhash64(*content)).withColumn("__twin", F.xxhash64(F.lit(1), *content))
    names = ["__same", "__twin"]
    twins = materialised(hashed.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MANY))
    found = twins.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n")).first()
    if not found["k"]:
        return hashed.withColumn("__copy", F.lit(0).cast("long"))
    if found["k"] <= BROADCAST_TWINS:
        single, copied = hashed.join(F.broadcast(twins), names, "left_anti"), hashed.join(F.broadcast(twins), names)
    else:
        hot, cold = split_hot(twins, found["n"])
        single, copied = hashed.join(F.broadcast(hot), names, "left_anti").join(cold, names, "left_anti"), join_ranks(hashed, twins, names, found["n"])
    single = single.withColumn("__copy", F.lit(0).cast("long"))
    one = copied.groupBy(*names).agg(F.first(F.struct(*[F.col(c) for c in docs.columns])).alias("__row"), F.first("n").alias("__n"))
    pieces = one.withColumn("__piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / PIECE)))).repartition(*names, "__piece")
    copies = pieces.withColumn("__copy", F.explode(F.sequence(F.col("__piece") * PIECE, F.least(F.col("__n"), (F.col("__piece") + 1) * PIECE) - 1)))
    return single.unionByName(copies.select("__row.*", *names, "__copy"))


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", seed: int = 17, bucket_rows: int = 128, bucket_bytes: int = 8 << 20) -> DataFrame:
    """`docs` with shard (int), slot (long, from 0 in each shard) and grown_shard (int, the shard if there were one more)."""
    docs, given = plainly_named(docs, ("shard", "slot", "grown_shard"))
    id_col, text_col = given[id_col], given[text_col]
    key, names = F.col(id_col), docs.columns
    rows = numbered_copies(docs).withColumn("shard", jump_shard(key, shards, seed))
    weights = {r["shard"]: r for r in rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text_or_empty(text_col))).alias("b")).collect()}  # a row a shard
    buckets = [max(1, -(-weights[k]["n"] // bucket_rows), -(-weights[k]["b"] // bucket_bytes)) if k in weights else 1 for k in range(shards)]
    scattered = rows.withColumn("__bucket", F.pmod(F.xxhash64("__same", "__copy", F.lit(seed + 1)), F.element_at(F.array(*[F.lit(b).cast("long") for b in buckets]), F.col("shard") + 1)))
    in_order = Window.partitionBy("shard").orderBy("__bucket")
    offsets = (
        scattered.groupBy("shard", "__bucket")
        .agg(F.count(F.lit(1)).alias("__n"))
        .select("shard", "__bucket", (F.sum("__n").over(in_order) - F.col("__n")).alias("__offset"))
    )
    record = F.struct(F.xxhash64("__same", "__copy", F.lit(seed + 2)).alias("draw"), F.col("__same").alias("same"), F.col("__twin").alias("twin"), F.col("__copy").alias("copy"), F.struct(*[F.col(c) for c in names]).alias("row"))
    gathered = scattered.repartition("shard", "__bucket").groupBy("shard", "__bucket").agg(F.collect_list(record).alias("__rows"))
    # the order before the shuffle: seeded hash, then the hashes and number of the row
    ranked = F.sort_array(F.transform("__rows", lambda r, k: F.struct(r["draw"].alias("draw"), r["same"].alias("same"), r["twin"].alias("twin"), r["copy"].alias("copy"), k.alias("k"))))
    permuted = F.transform(F.col("__order"), lambda p: F.get(F.col("__rows"), F.get(F.col("__ranked"), p)["k"])["row"])
    shuffled = (
        gathered.withColumn("__ranked", ranked)
        .withColumn("__order", fisher_yates(F.size("__rows"), F.col("shard"), F.col("__bucket"), seed))
        .select("shard", "__bucket", permuted.alias("__rows"))
        .join(offsets, ["shard", "__bucket"])
        .select("shard", "__offset", F.posexplode("__rows").alias("__at", "__row"))
    )
    out = shuffled.select("__row.*", "shard", (F.col("__offset") + F.col("__at")).cast("long").alias("slot"))
    grown = F.when(jump_shard(key, shards + 1, seed) == shards, F.lit(shards)).otherwise(F.col("shard"))
    return out.withColumn("grown_shard", grown.cast("int")).toDF(*given, "shard", "slot", "grown_shard")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, its files in slot order."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)
