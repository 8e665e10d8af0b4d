"""Mixing sources to target weights by a low-discrepancy schedule.

Targets: sources in code point order (null last) weigh 5, 2, 1, repeating, and share `budget`
times all words; a target stops at `most` times its source's size, and the excess is shared
again by weight among the others until none is above its limit (water filling).

Schedule: slot t holds the point frac((t + 1) / golden ratio), a low-discrepancy sequence; mapped
through the cumulative target weights it names the slot's source, so any stretch of slots holds
the sources in nearly their target shares. Slots are ranked within their source. Documents of a
source, in seeded hash order, form one stream of words that is cut into blocks of `block_words`;
rank r takes block r modulo the number of blocks, so a source whose target is above its size
goes through its blocks again. A source's last slot takes only the words that its target still
lacks, so taken words equal the target rounded down.

Scale: a document's place in its source's stream is an exact distributed prefix sum over hash
buckets whose number follows the source's size, so a source with a third of all rows is summed
in many tasks. Blocks hold equal words, so the join of blocks with slots has no hot key. Only
the table of sources is ordered in one task.

Edge cases: a null text or one without words has size 0 and is never taken; if all sizes are 0
all targets are 0; rows that repeat a doc_id are separate documents in the order of their text;
very long texts are split over as many blocks as they fill; an empty table gives no rows. Extra columns of any
name are passed through by :func:`mix_documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import WORDS, materialised, plainly_named, text_or_empty

#: The weights of sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: 1 / golden ratio in 64-bit fixed point.
GOLDEN = 0x9E3779B97F4A7C15
#: Grid cells of the unit interval, by which points and cumulative weights are joined.
CELLS = 4096
#: Slots that are ranked together; buckets whose words are summed together.
STRETCH, PART = 1 << 16, 1 << 12


def word_count(text: str | Column) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORDS)).cast("long")


def source_targets(sizes: DataFrame, budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, weight, target from a frame of source, source_size (one row a source)."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    limited = sizes.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    ratio = F.col("limit") / F.col("weight")
    by_ratio = Window.orderBy(ratio, F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    # the level that is left if the sources before this one stop at their limits
    level = (F.sum("source_size").over(everything) * budget - (F.sum("limit").over(by_ratio) - F.col("limit"))) / (F.sum("weight").over(everything) - (F.sum("weight").over(by_ratio) - F.col("weight")))
    leveled = limited.withColumn("ratio", ratio).withColumn("level", level)
    # sources are full up to the first whose own limit is above the level left to it
    leveled = leveled.withColumn("final", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(everything)["level"])
    target = F.least(F.col("limit"), F.coalesce(F.col("weight") * F.col("final"), F.col("limit")))
    return leveled.select("source", "source_size", "weight", target.alias("target"))


def schedule(targets: DataFrame, block_words: int) -> DataFrame:
    """key, rank, slot, pass, block, words: the blocks in the order (slot) in which the mix takes them.

    Ranks that a source still lacks after the last point of the sequence (its discrepancy, a few
    at most) follow after the last slot.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    goals = (
        targets.select(source_key("source").alias("key"), "source", "source_size", F.floor(F.col("target") + 1e-6).cast("long").alias("goal"))
        .where("goal > 0")
        .withColumn("n_blocks", F.ceil(F.col("source_size") / F.lit(block_words)).cast("long"))
        # whole passes over the blocks, of which the last may be short, and the blocks of the pass that stops
        .withColumn("whole", F.call_function("div", "goal", "source_size"))
        .withColumn("n_slots", F.col("whole") * F.col("n_blocks") + F.ceil((F.col("goal") - F.col("whole") * F.col("source_size")) / F.lit(block_words)).cast("long"))
        .drop("whole")
        .withColumn("upto", F.sum("goal").over(order) / F.sum("goal").over(Window.partitionBy()))
        .withColumn("since", F.lag("upto", 1, 0.0).over(order))
        .drop("source")
    )
    n = goals.select(F.coalesce(F.sum("n_slots"), F.lit(0)).alias("n")).first()["n"]
    x = F.pmod((F.col("id") + 1).cast("decimal(18,0)") * F.lit(str(GOLDEN)).cast("decimal(20,0)"), F.lit(str(1 << 64)).cast("decimal(20,0)")).cast("double") / F.lit(float(1 << 64))
    points = targets.sparkSession.range(n).select(F.col("id").alias("slot"), F.least(x, F.lit(1 - 2.0**-53)).alias("x")).withColumn("cell", F.floor(F.col("x") * CELLS))
    # cumulative weights by grid cell, so that points find their source by an equality join
    cells = goals.withColumn("cell", F.explode(F.sequence(F.floor(F.col("since") * CELLS), F.least(F.floor(F.col("upto") * CELLS), F.lit(CELLS - 1).cast("long")))))
    # the last source ends at 1 whatever the rounding of its sum
    last = F.col("upto") >= 1 - 1e-12
    named = points.join(cells, "cell").where((F.col("x") >= F.col("since")) & ((F.col("x") < F.col("upto")) | last)).select("slot", "key", F.floor(F.col("slot") / STRETCH).alias("part"))
    # a slot's rank: the source's slots in earlier stretches, and those before it in its own
    counts = named.groupBy("key", "part").agg(F.count(F.lit(1)).alias("k"))
    bases = counts.select("key", "part", (F.sum("k").over(Window.partitionBy("key").orderBy("part")) - F.col("k")).alias("base"))
    ranked = named.withColumn("own", F.row_number().over(Window.partitionBy("key", "part").orderBy("slot")) - 1).join(bases, ["key", "part"]).select("key", "slot", (F.col("base") + F.col("own")).alias("rank"))
    had = F.coalesce("k", F.lit(0).cast("long"))
    lacking = goals.join(counts.groupBy("key").agg(F.sum("k").alias("k")), "key", "left").where(had < F.col("n_slots"))
    lacking = lacking.select("key", F.explode(F.sequence(had, F.col("n_slots") - 1)).alias("rank")).select("key", (F.lit(n) + F.col("rank")).alias("slot"), "rank")
    turn = F.floor(F.col("rank") / F.col("n_blocks"))
    block = F.col("rank") - F.col("pass") * F.col("n_blocks")
    taken_before = F.col("pass") * F.col("source_size") + F.col("block") * block_words
    whole = F.least(F.lit(block_words).cast("long"), F.col("source_size") - F.col("block") * block_words)
    return (
        ranked.unionByName(lacking)
        .join(goals, "key")
        .withColumn("pass", turn)
        .withColumn("block", block)
        .withColumn("words", F.greatest(F.lit(0).cast("long"), F.least(whole, F.col("goal") - taken_before)))
        .where("words > 0")
        .select("key", "rank", "slot", "pass", "block", "words")
    )


def source_key(source: str | Column) -> Column:
    column = F.col(source) if isinstance(source, str) else source
    return F.xxhash64(column.isNull(), column)


def streamed(light: DataFrame, seed: int = 29, bucket_rows: int = 512) -> DataFrame:
    """A frame of doc_id, body, source, size with key, begin (the first word's place in the source's stream) and row (its number there in the bucket).

    Buckets are ranges of the seeded hash, so their order is the order of the stream.
    """
    n = max(1, -(-light.count() // bucket_rows))
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 33)
    drawn = light.withColumn("key", source_key("source")).withColumn("draw", draw).withColumn("bucket", F.shiftrightunsigned(F.col("draw") * F.lit(n).cast("long"), 31))
    sums = drawn.groupBy("key", "bucket").agg(F.sum("size").alias("words"))
    # words before a bucket: those of the stretches of buckets before its own, and those before it in there
    sums = sums.withColumn("part", F.floor(F.col("bucket") / PART))
    parts = sums.groupBy("key", "part").agg(F.sum("words").alias("all"))
    parts = parts.select("key", "part", (F.sum("all").over(Window.partitionBy("key").orderBy("part")) - F.col("all")).alias("base"))
    before = F.sum("words").over(Window.partitionBy("key", "part").orderBy("bucket")) - F.col("words")
    starts = sums.withColumn("before", before).join(parts, ["key", "part"]).select("key", "bucket", (F.col("base") + F.col("before")).alias("start"))
    order = Window.partitionBy("key", "bucket").orderBy("draw", "doc_id", "body")
    upto = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return drawn.withColumn("upto", upto).withColumn("row", F.row_number().over(order)).join(starts, ["key", "bucket"]).withColumn("begin", F.col("start") + F.col("upto") - F.col("size")).drop("draw", "words", "upto", "start")


def mix(light: DataFrame, block_words: int = 2048, seed: int = 29, bucket_rows: int = 512) -> tuple[DataFrame, DataFrame]:
    """(documents, targets) of a frame of doc_id, body (a hash of the text), source, size.

    documents has a row per input row: its columns, key, and `passes`, an array of
    (pass, words, slot): the document's first `words` words are taken in that pass, from `slot` on.
    """
    at = materialised(streamed(light, seed, bucket_rows))
    targets = source_targets(at.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")))
    plan = schedule(targets, block_words)
    place = ["key", "bucket", "row"]
    # words of a document by block: a block holds block_words words, so none is hot
    pieces = at.where("size > 0").select(*place, "begin", (F.col("begin") + F.col("size")).alias("end"), F.explode(F.sequence(F.floor(F.col("begin") / block_words), F.floor((F.col("begin") + F.col("size") - 1) / block_words))).alias("block"))
    base = F.col("block") * block_words
    words = F.least(F.col("end"), base + F.col("words")) - F.greatest(F.col("begin"), base)
    taken = pieces.join(plan, ["key", "block"]).select(*place, "pass", "slot", words.alias("words")).where("words > 0")
    passes = taken.groupBy(*place, "pass").agg(F.sum("words").alias("words"), F.min("slot").alias("slot")).groupBy(*place).agg(F.sort_array(F.collect_list(F.struct("pass", "words", "slot"))).alias("passes"))
    return at.join(passes, place, "left").drop("bucket", "row", "begin"), targets


def lighter(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("body"), F.col(source_col).alias("source"), word_count(text_col).alias("size"))


def mix_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, slot (the first at which words of the document are taken, null if none are): a row per input row."""
    rows, targets = mix(lighter(docs, id_col, text_col, source_col), **options)
    sources = targets.select(source_key("source").alias("key"), "source_size", "target")
    taken = F.coalesce(F.aggregate("passes", F.lit(0).cast("long"), lambda a, p: a + p["words"]), F.lit(0).cast("long"))
    return rows.join(sources, "key").select("doc_id", "size", "source_size", "target", taken.alias("taken"), "source", F.array_min(F.transform("passes", lambda p: p["slot"])).alias("slot"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: the columns of `docs`, a row per document and pass that takes words of it, in each partition in the order of the slots that take them.

    A document of which a pass takes only the first words has its text cut there, words joined by
    one space.
    """
    docs, names = plainly_named(docs)
    id_col, text_col, source_col = names[id_col], names[text_col], names[source_col]
    rows, _ = mix(lighter(docs, id_col, text_col, source_col), **options)
    same = ["__id", "__body", "__key"]
    nth = Window.partitionBy(*same)
    planned = rows.where("passes is not null").select(F.col("doc_id").alias("__id"), F.col("body").alias("__body"), F.col("key").alias("__key"), F.col("size").alias("__size"), "passes")
    planned = planned.withColumn("__nth", F.row_number().over(nth.orderBy("passes"))).withColumnRenamed("passes", "__passes")
    kept = docs.withColumns({"__id": F.col(id_col), "__body": F.xxhash64(F.col(text_col)), "__key": source_key(source_col)})
    kept = kept.withColumn("__nth", F.row_number().over(nth.orderBy(F.lit(0))))
    on = [planned[c].eqNullSafe(kept[c]) if c == "__id" else planned[c] == kept[c] for c in [*same, "__nth"]]
    joined = kept.join(planned, on).select(*[kept[c] for c in docs.columns], planned["__size"], F.explode(planned["__passes"]).alias("__pass"))
    part = F.array_join(F.slice(F.regexp_extract_all(F.col(text_col), F.lit(WORDS), F.lit(0)), F.lit(1), F.col("__pass.words").cast("int")), " ")
    text = F.when(F.col("__pass.words") >= F.col("__size"), F.col(text_col)).otherwise(part)
    ordered = joined.withColumn(text_col, text).sortWithinPartitions("__pass.slot")
    return ordered.select(*docs.columns).toDF(*names)
