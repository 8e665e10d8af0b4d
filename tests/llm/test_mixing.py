import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from eventloom.llm import mixing


def slow_targets(sizes):
    """source -> target by sharing again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target = {s: 0.0 for s in sizes}
    free, left = set(sizes), 1.5 * sum(sizes.values())
    while free and left > 1e-9:
        total = sum(weight[s] for s in free)
        share = left / total
        full = {s for s in free if weight[s] * share >= 2 * sizes[s]}
        if not full:
            for s in free:
                target[s] = weight[s] * share
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= full
    return target


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


CORPORA = [
    [(i, "w " * (i % 9 * 5 + 1), None, f"s{i % 4}" if i % 4 else None) for i in range(120)],
    [(i, "word " * 30, None, "big" if i % 3 == 0 else f"t{i % 20}") for i in range(90)] + [(500, "x " * 3000, None, "long"), (501, None, None, "none"), (502, "one", None, "tiny")],
    [(1, None, None, "a"), (2, "", None, "b")],
]


@pytest.mark.parametrize("rows", CORPORA)
@pytest.mark.parametrize("block", [7, 2048])
def test_targets_and_taken(make, rows, block):
    found = mixing.mix_report(make(rows), block_words=block, bucket_rows=16).collect()
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += words(t)
    target = slow_targets(dict(sizes))
    assert sorted((r.doc_id, r.size) for r in found) == sorted((i, words(t)) for i, t, _, _ in rows)
    taken = defaultdict(int)
    for r in found:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 * max(1, target[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert [(s, taken[s], target[s]) for s in target if not 0 <= target[s] - taken[s] + 1e-6 < 1.00001] == []


def test_reruns_agree(make):
    rows = CORPORA[0]
    one = sorted((r.doc_id, r.taken) for r in mixing.mix_report(make(rows), block_words=7).collect())
    two = sorted((r.doc_id, r.taken) for r in mixing.mix_report(make(rows[::-1]).repartition(5), block_words=7).collect())
    assert one == two


def test_documents_are_repeated_and_cut(make):
    df = make(CORPORA[0]).withColumn("extra", F.lit(1))
    report = {r.doc_id: r.taken for r in mixing.mix_report(df, block_words=7).collect()}
    taken = defaultdict(int)
    for r in mixing.mix_documents(df, block_words=7).collect():
        taken[r.doc_id] += words(r.text)
        assert r.extra == 1
    assert {i: n for i, n in report.items() if n} == dict(taken)


def test_hard_cases(hard, none):
    assert mixing.mix_report(hard).count() == hard.count()
    total = sum(r.taken for r in mixing.mix_report(hard).collect())
    assert sum(words(r.text) for r in mixing.mix_documents(hard).collect()) == total
    assert mixing.mix_report(none).count() == 0 and mixing.mix_documents(none).count() == 0


def test_columns_keep_their_values_whatever_their_names(make):
    names = ("__id", "__body", "__key", "__size", "__passes", "__nth", "__pass", "c0", "slot", "bucket")
    df = make(CORPORA[0])
    for k, name in enumerate(names):
        df = df.withColumn(name, F.concat(F.lit(f"{k}-"), "doc_id"))
    out = mixing.mix_documents(df, block_words=7)
    assert out.columns == df.columns
    rows = out.collect()
    assert rows and all(r[name] == f"{k}-{r.doc_id}" for r in rows for k, name in enumerate(names))


def test_the_mix_is_in_the_order_of_the_schedule(make):
    df = make(CORPORA[1])
    slot = {r.doc_id: r.slot for r in mixing.mix_report(df, block_words=7).collect()}
    first = {}
    for r in mixing.mix_documents(df, block_words=7).withColumn("part", F.spark_partition_id()).collect():
        first.setdefault(r.part, []).append(r.doc_id)
    for ids in first.values():
        order = [slot[i] for i in dict.fromkeys(ids)]
        assert order == sorted(order)


def test_schedule_is_even(spark):
    targets = spark.createDataFrame([("a", 60_000, 60_000.0), ("b", 30_000, 30_000.0), ("c", 10_000, 10_000.0)], "source string, source_size long, target double")
    keys = {r.k: r.source for r in targets.select("source", mixing.source_key("source").alias("k")).collect()}
    slots = [keys[r.key] for r in mixing.schedule(targets, 100).orderBy("slot").collect()]
    assert len(slots) == 1000
    for at in range(0, 1000, 50):
        assert abs(slots[at : at + 50].count("a") - 30) <= 3 and abs(slots[at : at + 50].count("c") - 5) <= 3
