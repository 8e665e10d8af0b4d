"""Sampling, anonymising and deduplicating rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.operators.numbering import numbered


def draw(keys: list[str], seed: int = 0) -> Column:
    """A seeded hash of the keys as a number from 0 to 1: the same for the same row in every run."""
    return F.shiftrightunsigned(F.xxhash64(*keys, F.lit(seed)), 11).cast("double") / F.lit(float(1 << 53))


def rate_sample(df: DataFrame, rate: float, keys: list[str], seed: int = 0) -> DataFrame:
    """Rows whose draw is below the rate, which is held to 0 .. 1."""
    return df.where(draw(keys, seed) < min(1.0, max(0.0, rate)))


def reservoir_sample(df: DataFrame, k: int, keys: list[str], seed: int = 0) -> DataFrame:
    """Exactly min(k, rows) rows, each set equally likely over seeds; every task keeps k at most."""
    return df.orderBy(F.xxhash64(*keys, F.lit(seed)), *keys).limit(k)


def stratified_sample(df: DataFrame, stratum: str, n: int, order: str) -> DataFrame:
    """The first n rows of each stratum."""
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(order))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")


def sample(df: DataFrame, keys: list[str], rate: float | None = None, count: int | None = None, stratify: str | None = None, per_stratum: int = 1, seed: int = 0) -> DataFrame:
    """By the first of rate, count and stratum that is given, else a tenth of the rows."""
    if rate is not None:
        return rate_sample(df, rate, keys, seed)
    if count is not None:
        return reservoir_sample(df, count, keys, seed)
    if stratify is not None:
        return stratified_sample(df, stratify, per_stratum, keys[0])
    return rate_sample(df, 0.1, keys, seed)


def anonymised(column: str, salt: str, digits: int = 16) -> Column:
    """The first digits of SHA-256(salt, value); empty and null stay."""
    c = F.col(column).cast("string")
    return F.when(c == "", c).otherwise(F.substring(F.sha2(F.concat(F.lit(salt), c), 256), 1, digits))


def anonymise(df: DataFrame, columns: list[str], salt: str) -> DataFrame:
    return df.withColumns({c: anonymised(c, salt) for c in columns})


def pseudonymise(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Values become a prefix and the number of the value in its column's order (column -> prefix); null and empty stay.

    The numbers come from the distinct values, joined back by value.
    """
    for column, prefix in columns.items():
        values = df.where(F.col(column).isNotNull() & (F.col(column) != "")).select(column).distinct()
        names = numbered(values, [column], "__name").withColumn("__name", F.concat(F.lit(prefix), "__name"))
        df = df.join(names, column, "left").withColumn(column, F.coalesce("__name", column)).drop("__name")
    return df


def record_key(df: DataFrame, columns: list[str] | None = None) -> Column:
    """SHA-256 of the named columns (all, in order of their names, by default) as JSON."""
    return F.sha2(F.to_json(F.struct(*sorted(columns or df.columns)), {"ignoreNullFields": "false"}), 256)


def deduplicate(df: DataFrame, keys: list[str], order: str, strategy: str = "keep_first") -> DataFrame:
    """One row per key: the first (keep_first, skip) or last (replace) by `order`; `error` fails on the first repeat."""
    by_key = Window.partitionBy(*keys)
    if strategy == "error":
        return df.withColumn("__n", F.count(F.lit(1)).over(by_key)).where(F.when(F.col("__n") > 1, F.raise_error(F.lit("repeated key")).isNull()).otherwise(F.lit(True))).drop("__n")
    if strategy not in ("keep_first", "skip", "replace"):
        raise ValueError(f"unknown strategy {strategy!r}")
    rank = F.row_number().over(by_key.orderBy(F.desc(order) if strategy == "replace" else F.asc(order)))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def repeats(df: DataFrame, keys: list[str]) -> DataFrame:
    """n_rows, n_unique and n_duplicates by the keys."""
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_unique"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"))


def bloom_bits(expected: int, false_positives: float) -> tuple[int, int]:
    """(bits, hashes) of a Bloom filter for so many values: -n ln p / ln 2 ** 2 bits, bits / n ln 2 hashes."""
    from math import ceil, log

    bits = max(64, ceil(-expected * log(false_positives) / log(2) ** 2))
    return bits, max(1, round(bits / max(1, expected) * log(2)))


def bloom_slots(column: Column, bits: int, hashes: int) -> Column:
    """The bit numbers of a value: two hashes combined."""
    a, b = F.xxhash64(column), F.xxhash64(column, F.lit(1))
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.pmod(a + F.pmod(b, F.lit(1 << 31)) * i % F.lit(1 << 31), F.lit(bits)))


def bloom_filter(df: DataFrame, column: str, bits: int, hashes: int) -> DataFrame:
    """The set bits of the filter over a column's values, a row a bit."""
    return df.where(F.col(column).isNotNull()).select(F.explode(bloom_slots(F.col(column), bits, hashes)).alias("bit")).distinct()


def maybe_contained(df: DataFrame, key: str, column: str, filter_bits: DataFrame, bits: int, hashes: int) -> DataFrame:
    """Rows (by `key`) all of whose bits are in the filter: every contained value, and few others."""
    asked = df.select(key, F.explode(bloom_slots(F.col(column), bits, hashes)).alias("bit")).distinct()
    sizes = asked.groupBy(key).agg(F.count(F.lit(1)).alias("asked"))
    hits = asked.join(filter_bits, "bit").groupBy(key).agg(F.count(F.lit(1)).alias("hit"))
    return sizes.join(hits, key).where("asked = hit").select(key)
