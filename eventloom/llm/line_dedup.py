"""Line deduplication over a suffix array of line ids, in DataFrame and SQL functions alone.

Every document is the sequence of the ids (64-bit hashes) of its lines that are not blank. The
suffixes of all sequences are ranked by prefix doubling (see :mod:`eventloom.llm.ranks`) up to `min_lines`. Positions that then share
a rank are an interval of the suffix array whose longest common prefix is at least `min_lines`
lines: all but the earliest (by doc_id, then place) are later copies. Neighbouring copies join to
maximal runs, which are deleted; blank lines stay.

Skew: counting combines before the shuffle, so a line that stands in every document is one row
per task, and hot ranks are handed back by a bounded broadcast.

Edge cases: a null or empty text has one (blank) line and keeps its text; documents with fewer
lines than a run lose nothing; very long texts and texts of very many lines are treated whole, in time that grows with
their length; rows with the same doc_id and text count as one document; a null
doc_id comes after all others; an empty table gives no rows. Extra columns are not read. Lines are told apart by their
ids alone: two different lines with one id would count as equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm import ranks
from eventloom.llm.common import plainly_named, text_or_empty

MIN_LINES = 3
FULL = r"[^\x20\x09-\x0D]"


def _lines(text: str) -> Column:
    return F.split(text_or_empty(text), "\n")


def positions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, body (a hash of the text), pos (number among the lines that are not blank), at (number among all), rank (the line's id)."""
    full = F.filter(F.transform(_lines(text_col), lambda line, at: F.struct(at.alias("at"), F.when(line.rlike(FULL), F.xxhash64(line)).alias("rank"))), lambda x: x["rank"].isNotNull())
    # the hash of the text is made before the lines become rows, not for each of them
    read = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("body"), full.alias("full"))
    return read.select("id", "body", F.posexplode("full").alias("pos", "x")).select("id", "body", "pos", "x.at", "x.rank")


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, body, first, last (numbers among all lines), n (lines that are not blank) of the maximal runs of later copies: lines in `min_lines` lines that also start earlier."""
    sequence = ["id", "body"]
    rows = positions(docs, id_col, text_col).dropDuplicates([*sequence, "pos"])
    rows, total = ranks.repeated(rows, sequence, min_lines)
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "pos", "body")
    earliest = rows.groupBy("rank").agg(F.min(place).alias("earliest"), F.count(F.lit(1)).alias("n"))
    # rows of one document id and place in different texts are copies of the first of them
    copies = ranks.join_ranks(rows, earliest, ["rank"], total).where(place > F.col("earliest"))
    # neighbouring copies overlap: a new run starts where the place is further than a run from the one before
    order = Window.partitionBy(*sequence).orderBy("pos")
    starts = copies.withColumn("gap", F.col("pos") - F.coalesce(F.lag("pos").over(order), F.lit(-min_lines - 1)) > min_lines).withColumn("run", F.sum(F.col("gap").cast("int")).over(order))
    return starts.groupBy(*sequence, "run").agg(F.min("at").alias("first"), F.max("upto").alias("last"), (F.max("pos") + min_lines - F.min("pos")).cast("long").alias("n")).drop("run")


def drop_repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with n_lines, n_removed and kept_text; input columns of these names are replaced."""
    docs, names = plainly_named(docs, ("n_lines", "n_removed", "kept_text"))
    id_col, text_col = names[id_col], names[text_col]
    runs = repeated_runs(docs, min_lines, id_col, text_col).groupBy("id", "body").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("__runs"), F.sum("n").alias("n_removed"))
    runs = runs.select(F.col("id").alias("__id"), F.col("body").alias("__same"), "__runs", "n_removed")
    keyed = docs.withColumn("__body", F.xxhash64(F.col(text_col)))
    joined = keyed.join(runs, keyed[id_col].eqNullSafe(runs["__id"]) & (keyed["__body"] == runs["__same"]), "left")

    # for each line whether a run holds it, put together run by run; a lambda's argument is made once, not for every line
    def stretch(run: Column, k: Column) -> Column:
        begin = F.coalesce(F.get("__runs", k - 1)["last"] + 1, F.lit(0))
        return F.concat(F.array_repeat(F.lit(False), run["first"] - begin), F.array_repeat(F.lit(True), run["last"] - run["first"] + 1))

    inside = F.flatten(F.transform("__runs", stretch))
    stays = F.transform(F.array(inside), lambda mask: F.filter(_lines(text_col), lambda line, at: ~F.coalesce(F.get(mask, at), F.lit(False)) | ~line.rlike(FULL)))
    kept = F.array_join(F.get(stays, F.lit(0)), "\n")
    return (
        joined.withColumn("n_lines", F.size(_lines(text_col)).cast("long"))
        .withColumn("n_removed", F.coalesce("n_removed", F.lit(0).cast("long")))
        .withColumn("kept_text", F.when(F.col("__runs").isNotNull(), kept).otherwise(F.col(text_col)))
        .select(*docs.columns, "n_lines", "n_removed", "kept_text")
        .toDF(*names, "n_lines", "n_removed", "kept_text")
    )
