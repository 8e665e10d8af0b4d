"""Data quality: column profiles, log quality reports, checksums and data contracts."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.session import materialised



def column_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column_name, n_rows, n_nulls, n_distinct of every column, in one pass over the rows."""
    columns = columns or df.columns
    stats = [F.struct(F.lit(c).alias("column_name"), F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(c).isNull()).alias("n_nulls"), F.countDistinct(F.col(c)).alias("n_distinct")).alias(f"c{i}") for i, c in enumerate(columns)]
    return df.agg(*stats).select(F.explode(F.array(*[F.col(f"c{i}") for i in range(len(columns))])).alias("c")).select("c.*")


def profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column_counts with null percentage, smallest and largest value as text, ratio of distinct values and its class."""
    columns = columns or df.columns
    texts = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    ranges = texts.agg(*[F.struct(F.lit(c).alias("column_name"), F.min(c).alias("min_value"), F.max(c).alias("max_value")).alias(f"c{i}") for i, c in enumerate(columns)])
    ranges = ranges.select(F.explode(F.array(*[F.col(f"c{i}") for i in range(len(columns))])).alias("c")).select("c.*")
    ratio = F.col("n_distinct") / F.nullif(F.col("n_rows") - F.col("n_nulls"), F.lit(0))
    kind = F.when(ratio > 0.99, "unique").when(ratio > 0.5, "high").when(ratio > 0.1, "medium").otherwise("low")
    return column_counts(df, columns).join(ranges, "column_name").withColumn("null_percent", F.round(F.col("n_nulls").cast("double") * 100 / F.col("n_rows"), 6)).withColumn("unique_ratio", F.round(ratio, 6)).withColumn("uniqueness", kind)


def entropy(df: DataFrame, column: str) -> DataFrame:
    """Shannon entropy in bits, and as a share of the largest that so many values could have."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    shares = counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy()))
    return shares.agg(F.round(-F.sum(F.col("p") * F.log2("p")), 6).alias("entropy"), F.round(F.when(F.count(F.lit(1)) > 1, -F.sum(F.col("p") * F.log2("p")) / F.log2(F.count(F.lit(1)))).otherwise(F.lit(0.0)), 6).alias("normalised"))


def approximate_distinct(df: DataFrame, column: str, precision: int = 14) -> DataFrame:
    """Distinct values by a HyperLogLog sketch of 2 ** precision registers."""
    return df.agg(F.hll_sketch_estimate(F.hll_sketch_agg(column, precision)).alias("estimate"))


def merged_distinct(df: DataFrame, column: str, by: str, precision: int = 14) -> DataFrame:
    """The same from sketches of the groups `by`, merged."""
    parts = df.groupBy(by).agg(F.hll_sketch_agg(column, precision).alias("sketch"))
    return parts.agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))


def checksum(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """n_rows and an order-independent checksum: equal for equal bags of rows."""
    row = F.xxhash64(*[F.col(c) for c in columns or sorted(df.columns)])
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.bit_xor(row), F.lit(0)).alias("xor"), F.coalesce(F.sum(F.pmod(row, F.lit(1 << 40))), F.lit(0)).alias("total"))


def fnv64a(data: bytes) -> int:
    """The 64-bit FNV-1a hash of a byte string, for comparing single files."""
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def log_quality(log: DataFrame) -> DataFrame:
    """Counts of missing roles, repeats and events of a log, and the share of complete events in percent."""
    missing = lambda c: F.col(c).isNull() | (F.col(c).cast("string") == "")
    complete = ~missing("case_id") & ~missing("activity") & (F.coalesce("timestamp", F.lit(0)) > 0)
    return log.agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count_if(missing("case_id")).alias("no_case"),
        F.count_if(missing("activity")).alias("no_activity"),
        F.count_if(F.coalesce("timestamp", F.lit(0)) <= 0).alias("no_time"),
        F.count_if(missing("resource")).alias("no_resource"),
        F.round(F.count_if(complete).cast("double") * 100 / F.count(F.lit(1)), 6).alias("completeness"),
    )


def top_values(df: DataFrame, columns: list[str], most: int = 10) -> DataFrame:
    """column_name, value, n, share (percent of the column's values that are not null), rank of the `most` most frequent values of each column; ties by value. Values are counted once for all columns."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])
    counts = df.select(F.explode(pairs).alias("x")).select("x.*").where("value is not null").groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("column_name").agg(F.sum("n").alias("total"))
    order = Window.partitionBy("column_name").orderBy(F.desc("n"), "value")
    ranked = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return ranked.join(totals, "column_name").select("column_name", "value", "n", F.round(F.col("n").cast("double") * 100 / F.col("total"), 6).alias("share"), "rank")


def report(log: DataFrame, most: int = 10) -> DataFrame:
    """The quality report as (section, name, value): counts and completeness, uniqueness of cases, activities and resources, events per case, the most frequent activities and resources."""
    line = lambda section, name, value: F.struct(F.lit(section).alias("section"), F.lit(name).alias("name"), value.cast("double").alias("value"))
    wide = log_quality(log)
    first = wide.select(F.explode(F.array(*[line("completeness", c, F.col(c)) for c in wide.columns])).alias("r")).select("r.*")
    distinct = log.agg(*[F.countDistinct(c).alias(c) for c in ("case_id", "activity", "resource")])
    second = distinct.select(F.explode(F.array(*[line("uniqueness", c, F.col(c)) for c in distinct.columns])).alias("r")).select("r.*")
    cases = log.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"))
    third = cases.select(F.explode(F.array(*[line("events per case", c, F.col(c)) for c in cases.columns])).alias("r")).select("r.*")
    top = top_values(log, ["activity", "resource"], most).select(F.concat(F.lit("top "), "column_name").alias("section"), F.col("value").alias("name"), F.col("n").cast("double").alias("value"))
    return first.unionByName(second).unionByName(third).unionByName(top)


def issues(log: DataFrame) -> DataFrame:
    """severity, issue, n: missing roles are errors, repeats and few events warnings."""
    from eventloom.operators import mining

    found = log_quality(log).withColumn("j", F.lit(1))
    repeated = mining.duplicates(log).withColumn("j", F.lit(1))
    cases = log.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).agg(F.avg("n").alias("mean"), (F.count_if(F.col("n") == 1) / F.count(F.lit(1))).alias("single")).withColumn("j", F.lit(1))
    wide = found.join(repeated, "j").join(cases, "j")
    rows = F.array(
        _issue("error", "events without a case", F.col("no_case"), F.col("no_case") > 0),
        _issue("error", "events without an activity", F.col("no_activity"), F.col("no_activity") > 0),
        _issue("error", "events without a time", F.col("no_time"), F.col("no_time") > 0),
        _issue("warning", "repeated events", F.col("n_duplicates"), F.col("n_duplicates") > 0),
        _issue("warning", "over half the events without a resource", F.col("no_resource"), F.col("no_resource") * 2 > F.col("n_events")),
        _issue("warning", "under two events per case", F.col("n_events"), F.col("mean") < 2),
        _issue("warning", "over 30 % of cases with one event", F.col("n_events"), F.col("single") > 0.3),
    )
    return wide.select(F.explode(F.filter(rows, lambda r: r["holds"])).alias("r")).select("r.severity", "r.issue", "r.n")


def _issue(severity: str, text: str, n: Column, holds: Column) -> Column:
    return F.struct(F.lit(severity).alias("severity"), F.lit(text).alias("issue"), n.cast("long").alias("n"), holds.alias("holds"))


def quality_score(df: DataFrame) -> DataFrame:
    """The mean completeness of the columns in percent, and how many are constant or mostly null."""
    counts = column_counts(df)
    return counts.agg(F.round(F.avg((F.col("n_rows") - F.col("n_nulls")).cast("double") * 100 / F.col("n_rows")), 6).alias("score"), F.count_if(F.col("n_distinct") <= 1).alias("n_constant"), F.count_if(F.col("n_nulls") * 2 > F.col("n_rows")).alias("n_mostly_null"))


def rank_percentiles(df: DataFrame, column: str, shares: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """For each share p the sorted value number floor(n p), at most the last: by ranks over the histogram of values."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("k"))
    # values sorted in ranges; counts summed within a range, and over the ranges before it
    part = F.shiftrightunsigned("id", 33)
    kept = materialised(counts.orderBy("v").withColumn("id", F.monotonically_increasing_id())).withColumn("part", part)
    sizes = kept.groupBy("part").agg(F.sum("k").alias("size"))
    sizes = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"), F.sum("size").over(Window.partitionBy()).alias("n"))
    upto = kept.join(F.broadcast(sizes), "part").withColumn("upto", F.col("before") + F.sum("k").over(Window.partitionBy("part").orderBy("id")))
    at = lambda p: F.least(F.floor(F.col("n") * F.lit(p)), F.col("n") - 1)
    return upto.agg(*[F.min(F.when(F.col("upto") > at(p), F.col("v"))).alias(f"p{round(p * 100)}") for p in shares])


def _kind(column: str) -> Column:
    """The narrowest type of a text."""
    c = F.trim(F.col(f"`{column}`"))
    return (
        F.when(c.isNull() | c.isin(*NULL_TOKENS), "null")
        .when(F.lower(c).isin("true", "false", "yes", "no"), "bool")
        .when(c.rlike(r"^[+-]?\d{1,18}$"), "int")
        .when(c.rlike(r"^[+-]?(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?$"), "float")
        .when(c.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"), "timestamp")
        .otherwise("string")
    )


#: The types that a value can be of.
KINDS = ("null", "bool", "int", "float", "timestamp", "string")


def all_type_votes(df: DataFrame) -> dict[str, dict[str, int]]:
    """For each column how many of its values are of each type, of all columns in one pass."""
    kinds = df.select(*[_kind(c).alias(f"c{i}") for i, c in enumerate(df.columns)])
    row = kinds.agg(*[F.count_if(F.col(f"c{i}") == k).alias(f"c{i}_{k}") for i in range(len(df.columns)) for k in KINDS]).first()
    return {c: {k: row[f"c{i}_{k}"] for k in KINDS if row[f"c{i}_{k}"]} for i, c in enumerate(df.columns)}


def type_votes(df: DataFrame, column: str) -> DataFrame:
    """How many values of a text column are of each type: each value has its narrowest."""
    return df.select(_kind(column).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


#: Texts that mean null on ingest.
NULL_TOKENS = ("", "NULL", "null", "NA", "N/A", "n/a", "None", "none", "nil", "-", "\\N")


@dataclass
class Contract:
    """What a table promises: columns and types, size, and limits that :func:`violations` evaluates."""

    name: str
    columns: dict[str, str]
    n_rows: int
    checksum: int
    max_null_percent: dict[str, float] = field(default_factory=dict)
    min_rows: int | None = None
    max_rows: int | None = None

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Contract:
        return cls(**json.loads(text))


def make_contract(df: DataFrame, name: str, **limits) -> Contract:
    row = checksum(df).first()
    return Contract(name, dict(df.dtypes), row["n_rows"], row["xor"], **limits)


def violations(df: DataFrame, contract: Contract, tolerance: float = 0.1) -> list[str]:
    """What a table breaks of a contract; a size off by over `tolerance` is a warning."""
    have = dict(df.dtypes)
    found = [f"error: column {c} is missing" for c in contract.columns if c not in have]
    found += [f"error: column {c} is {have[c]}, not {t}" for c, t in contract.columns.items() if c in have and have[c] != t]
    limits = {c: p for c, p in contract.max_null_percent.items() if c in have}
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"null_{i}") for i, c in enumerate(limits)]).first()
    n = row["n"]
    if contract.n_rows and abs(n - contract.n_rows) > tolerance * contract.n_rows:
        found.append(f"warning: {n} rows, not about {contract.n_rows}")
    if contract.min_rows is not None and n < contract.min_rows:
        found.append(f"error: {n} rows, under {contract.min_rows}")
    if contract.max_rows is not None and n > contract.max_rows:
        found.append(f"error: {n} rows, over {contract.max_rows}")
    for i, (c, most) in enumerate(limits.items()):
        if n and row[f"null_{i}"] * 100 > most * n:
            found.append(f"error: column {c} has {row[f'null_{i}'] * 100 / n:.2f} % nulls, over {most}")
    return found
