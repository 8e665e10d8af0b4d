import re

from pyspark.sql import functions as F

import corpus_pipeline
from eventloom.llm import language, mixing


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_stages_name_functions_and_keep_columns(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    names = docs.columns
    counts = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / name)
        stage(spark, docs, data).write.parquet(path)
        docs = spark.read.parquet(path)
        counts.append(docs.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == names
    assert counts[0] >= counts[1] >= counts[2] > 0
    assert counts[4] == counts[3]
    assert set(docs.columns) == {*names, "shard", "slot", "grown_shard"}


def test_hard_documents_have_the_stated_results(spark, data, hard):
    stages = dict(corpus_pipeline.STAGES)
    given = sorted((r.doc_id, r.text) for r in hard.collect() if r.doc_id is not None and r.text)
    # language: texts without a letter go, and those that no language is sure of
    kept = stages["language_id"](spark, hard, data).collect()
    model = language.train(hard, language.fold() != 2)
    sure = [(r.doc_id, r.text) for r in language.predict(hard, model).where("lang_pred <> 'und' and score >= 0.5").collect()]
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted(sure, key=repr)
    assert not {4, 5, 6, 11} & {r.doc_id for r in kept} and all(r.text for r in kept)
    # near copies: the smallest id of a class stays, with all its rows; texts without a word are alike
    kept = stages["simhash_dedup"](spark, hard, data).collect()
    assert sorted(r.doc_id for r in kept) == [1, 4, 7, 8, 10, 10, 11, 12]
    # no benchmark item is in them
    kept = stages["decontamination"](spark, hard, data).collect()
    assert sorted((r.doc_id, r.text) for r in kept if r.doc_id is not None and r.text) == given and len(kept) == hard.count()
    # the mix has the words that the report says, and no text without words
    kept = stages["mixing"](spark, hard, data).collect()
    assert all(words(r.text) for r in kept)
    assert sum(words(r.text) for r in kept) == sum(r.taken for r in mixing.mix_report(hard).collect())
    # every row has a slot of its own
    kept = stages["sharding"](spark, hard, data).collect()
    assert len(kept) == hard.count() and len({(r.shard, r.slot) for r in kept}) == len(kept)
    assert sorted((r.doc_id, r.text) for r in kept if r.doc_id is not None and r.text) == given


def test_empty_tables_stay_empty(spark, data, none):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, data).count() == 0


def test_extra_columns_come_through(spark, data, hard):
    wide = hard.withColumn("slot", F.lit("own")).withColumn("root", F.lit(1)).withColumn("__id", F.lit(2.5)).withColumn("n", F.lit("n")).withColumn("lang_pred", F.lit("x"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, data)
        assert out.columns == wide.columns
        assert {(r.slot, r.root, r["__id"], r.n, r.lang_pred) for r in out.collect()} == {("own", 1, 2.5, "n", "x")}


def test_very_long_texts_pass(spark, data, make):
    long = " ".join(f"word{i % 5003} of the long text" for i in range(60_000))
    df = make([(1, long, "en", "a"), (2, long + " more", "en", "a"), (3, "ein kurzer deutscher text", "de", "b")])
    assert sorted(r.doc_id for r in dict(corpus_pipeline.STAGES)["simhash_dedup"](spark, df, data).collect()) == [1, 3]
    mixed = dict(corpus_pipeline.STAGES)["mixing"](spark, df, data).collect()
    assert sum(words(r.text) for r in mixed) == sum(r.taken for r in mixing.mix_report(df).collect())
    for name in ("language_id", "decontamination", "sharding"):
        assert dict(corpus_pipeline.STAGES)[name](spark, df, data).count() == 3
