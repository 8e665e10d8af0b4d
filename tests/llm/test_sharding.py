import struct
import zlib
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from eventloom.llm import queries, sharding
from eventloom.llm.sharding import fisher_yates, shard_documents


def test_hard_cases(hard, none):
    kept = shard_documents(hard.withColumn("__rows", F.lit(1)).withColumn("__n", F.lit("n")), 8, bucket_rows=2)
    assert kept.select("__rows", "__n").distinct().collect() == [(1, "n")]
    clash = hard.withColumn("slot", F.lit("x")).withColumn("__rows", F.lit(1)).withColumn("m", F.create_map(F.lit("k"), F.lit(1)))
    rows = shard_documents(clash, 8, bucket_rows=2).collect()
    assert shard_documents(hard.withColumn("n", F.lit("kept")), 8).select("n").distinct().collect() == [("kept",)]
    assert sorted((r.doc_id, r.text) for r in rows if r.doc_id and r.text) == sorted((r.doc_id, r.text) for r in hard.collect() if r.doc_id and r.text)
    assert len(rows) == hard.count()
    for s in range(8):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    assert len({r.shard for r in rows if r.doc_id is None}) == 1
    assert shard_documents(none, 8).count() == 0


def test_reruns_agree_and_more_shards_only_take(make):
    df = make([(i, f"text {i % 5}") for i in range(700)])
    eight = {r.doc_id: r for r in shard_documents(df, 8, bucket_rows=20).collect()}
    again = {r.doc_id: r for r in shard_documents(df.repartition(7).orderBy(F.rand(3)), 8, bucket_rows=20).collect()}
    assert {i: (r.shard, r.slot) for i, r in eight.items()} == {i: (r.shard, r.slot) for i, r in again.items()}
    nine = {r.doc_id: r.shard for r in shard_documents(df, 9, bucket_rows=20).collect()}
    assert all(nine[i] == r.grown_shard and (nine[i] == 8 or nine[i] == r.shard) for i, r in eight.items())
    assert 40 < sum(s == 8 for s in nine.values()) < 120
    order = [r.doc_id for r in sorted(eight.values(), key=lambda r: (r.shard, r.slot)) if r.shard == 0]
    assert order != sorted(order)


def test_fisher_yates_permutes(spark):
    rows = spark.range(0, 40).select(F.col("id").cast("int").alias("n")).withColumn("p", fisher_yates(F.col("n"), F.col("n"), 3)).where("n > 0").collect()
    assert all(sorted(r.p) == list(range(r.n)) for r in rows)
    assert any(r.p != sorted(r.p) for r in rows)


def spark_hash(*values):
    """xxhash64 of Spark: longs (int) and ints ((int,)) by their bytes, texts in UTF-8, each seeded with the one before; nulls change nothing."""
    h = 42
    for v in values:
        if v is not None:
            data = v.encode() if isinstance(v, str) else struct.pack("<i", v[0]) if isinstance(v, tuple) else struct.pack("<q", v)
            h = xxhash.xxh64_intdigest(data, h)
    return h


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def plain_shards(rows, shards, seed, bucket_rows, many):
    """{shard: rows in the order of their slots} by plain jump hashing and Fisher-Yates; rows are (doc_id, text)."""

    def shard_of(key):
        found = 0
        for j in range(1, shards):
            if (spark_hash(key, (j,), (seed,)) >> 11) / (1 << 53) < 1 / (j + 1):
                found = j
        return found

    seen, placed, equal = Counter(), {}, Counter(rows)
    for i, t in sorted(rows, key=repr):
        placed.setdefault(shard_of(i), []).append((i, t, signed(spark_hash(i, t)), signed(spark_hash((1,), i, t)), seen[i, t]))
        seen[i, t] += equal[i, t] > many
    out = {}
    for shard, members in placed.items():
        buckets = max(1, -(-len(members) // bucket_rows))
        parts = {}
        for i, t, same, twin, copy in members:
            parts.setdefault(signed(spark_hash(same, copy, (seed + 1,))) % buckets, []).append((signed(spark_hash(same, copy, (seed + 2,))), same, twin, copy, i, t))
        out[shard] = []
        for bucket in sorted(parts):
            order = [x[4:] for x in sorted(parts[bucket], key=lambda x: x[:4])]
            for k in range(len(order) - 1, 0, -1):
                j = signed(spark_hash((k,), (shard,), bucket, (seed,))) % (k + 1)
                order[k], order[j] = order[j], order[k]
            out[shard] += order
    return out


def test_equals_plain_jump_hashing_and_fisher_yates(make, hard, monkeypatch):
    rows = [(i, f"text {i % 5}") for i in range(300)] + [(7, "again")] * 90 + [(None, f"none {i}") for i in range(150)] + [(r.doc_id, r.text) for r in hard.collect()]
    df = make(rows).select("doc_id", "text")
    for shards, many, light in ((1, 256, 9), (3, 1, 9), (8, 50, 9), (8, 1, 0)):
        monkeypatch.setattr(sharding, "MANY", many)
        monkeypatch.setattr(sharding, "BROADCAST_TWINS", light)
        got = {}
        for r in shard_documents(df, shards, bucket_rows=20).orderBy("shard", "slot").collect():
            got.setdefault(r.shard, []).append((r.doc_id, r.text))
        assert got == plain_shards(rows, shards, 17, 20, many)


def test_one_hot_id_is_spread_over_buckets(spark):
    """A third of all rows are equal and another third have no id: buckets stay small."""
    n = 24_000
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit(5)).when(F.col("id") % 3 == 1, F.col("id")).cast("long").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same")).otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    rows = shard_documents(df, 8).groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("last"), F.countDistinct("slot").alias("slots")).collect()
    assert sum(r.n for r in rows) == n and all(r.last == r.n - 1 and r.slots == r.n for r in rows)
    copies = sharding.numbered_copies(df).where("doc_id = 5 and text = 'same'").agg(F.countDistinct("__copy").alias("k"), F.count("*").alias("n")).first()
    assert copies.k == copies.n == n // 3


def test_shards_are_written_in_order(make, tmp_path):
    path = str(tmp_path / "shards")
    df = make([(i, f"t{i}") for i in range(50)])
    sharding.write_shards(shard_documents(df, 4), path)
    back = df.sparkSession.read.parquet(path)
    assert back.count() == 50 and {r.shard for r in back.select("shard").distinct().collect()} <= {0, 1, 2, 3}


def test_query_columns(spark, data):
    rows = queries.op9_sharding(spark, data).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert all(r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows)
