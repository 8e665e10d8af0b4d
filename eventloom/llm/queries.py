"""Queries of this subpackage: `opN_<name>` applies operator N to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import decontaminate, exact_dedup, language, line_dedup, mixing, sharding, simhash, substring_dedup, suffix_dedup, warc
from eventloom.llm.common import table, text_or_empty

Query = Callable[[SparkSession, str], DataFrame]


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, k=3)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.drop_repeated_phrases(table(spark, sf_dir, "documents"), words=20)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "utf-8"), 256).alias("kept_sha256"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_lines=3)
    return cut.select("doc_id", "n_lines", "n_removed", F.sha2(F.encode(text_or_empty("kept_text"), "utf-8"), 256).alias("kept_sha256"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "contaminated", "n_items", "item_ids")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(table(spark, sf_dir, "pages")).drop("payload", "url")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.drop_repeated_bytes(table(spark, sf_dir, "documents"), size=400)
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = sharding.shard_documents(table(spark, sf_dir, "documents"), shards=8)
    body = text_or_empty("text")
    return sharded.select(
        "doc_id",
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(F.encode(body, "utf-8")).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "slot",
        "grown_shard",
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_simhash, op2_substring_dedup, op3_exact_dedup, op4_line_dedup, op5_language_id, op6_decontaminate, op7_warc, op8_suffix_dedup, op9_sharding, op10_mixing)}


EXACT_DEDUP_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""


LINE_DEDUP_SQL = r"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS nr FROM split),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY nr) AS pos FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
w AS (
  SELECT doc_id, pos, line AS a, lead(line, 1) OVER d AS b, lead(line, 2) OVER d AS c FROM f WINDOW d AS (PARTITION BY doc_id ORDER BY pos)
),
later AS (
  SELECT doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS n FROM w WHERE c IS NOT NULL) t WHERE n > 1
),
gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM later, range(3) AS r(k)),
kept AS (
  SELECT l.doc_id, l.nr, l.line, g.pos IS NOT NULL AS gone
  FROM l LEFT JOIN f ON l.doc_id = f.doc_id AND l.nr = f.nr LEFT JOIN gone g ON f.doc_id = g.doc_id AND f.pos = g.pos
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY nr) FILTER (NOT gone), '')) AS kept_sha256
FROM kept GROUP BY doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": EXACT_DEDUP_SQL, "op4_line_dedup": LINE_DEDUP_SQL}
