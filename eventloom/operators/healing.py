"""Finding and repairing damage in rows of delimited text, as column expressions.

Detection gives each row the patterns it shows with a confidence; repair applies the rules in
their order of priority. All but numeric HTML entities beyond the Basic Latin and Latin-1 range
is done with built-in functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Named HTML entities that are replaced, & last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&reg;", "®"), ("&euro;", "€"), ("&pound;", "£"), ("&amp;", "&"))
#: Delimiters that a row may have by mistake.
DELIMITERS = (",", "\t", ";", "|")
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"

#: Rules in the order in which they are applied, with the patterns that ask for them.
RULES = {
    "encoding": ("bom", "replacement"),
    "nul": ("nul",),
    "newlines": ("carriage_return",),
    "entities": ("html_entity",),
    "quotes": ("odd_quotes",),
    "escapes": ("escape",),
    "delimiter": ("wrong_delimiter",),
    "whitespace": ("outer_space",),
    "columns": ("column_count",),
}


def count_of(c: Column, text: str) -> Column:
    """How often a one-character text occurs."""
    return F.length(c) - F.length(F.replace(c, F.lit(text), F.lit("")))


def patterns(column: str | Column, delimiter: str = ",", columns: int | None = None) -> Column:
    """array of (pattern, confidence) that a row shows; a binary row shows nothing else."""
    c = F.col(column) if isinstance(column, str) else column
    binary = F.regexp_count(F.substring(c, 1, 4096), F.lit(CONTROL)) > F.length(F.substring(c, 1, 4096)) * 0.1
    others = [count_of(c, d) for d in DELIMITERS if d != delimiter]
    most = F.greatest(*others)
    tests = [
        ("bom", c.startswith("\ufeff"), F.lit(1.0)),
        ("replacement", c.contains("\ufffd"), F.lit(0.9)),
        ("odd_quotes", count_of(c, '"') % 2 == 1, F.lit(0.95)),
        ("wrong_delimiter", (most > F.lit((columns or 1) - 1)) & (most > 2) & (count_of(c, delimiter) < most), most / (most + F.lit((columns or 1) - 1) + 1)),
        ("carriage_return", c.contains("\r"), F.lit(0.85)),
        ("nul", c.contains("\x00"), F.lit(1.0)),
        ("outer_space", c != F.trim(c), F.lit(0.7)),
        ("escape", c.rlike(r"\\$") | c.rlike(r"\\[^nrt\"'\\0/bfuNx]"), F.when(c.rlike(r"\\$"), 0.9).otherwise(0.8)),
        ("html_entity", c.rlike(r"&(#\d+|#x[0-9a-fA-F]+|[a-zA-Z]+);"), F.lit(0.95)),
        ("truncated", c.rlike(r'"[^",;|\t\n]+$') & (count_of(c, '"') % 2 == 0), F.lit(0.7)),
    ]
    if columns:
        tests.append(("column_count", count_of(c, delimiter) != columns - 1, F.lit(0.9)))
    found = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(name).alias("pattern"), confidence.cast("double").alias("confidence"))) for name, test, confidence in tests]))
    return F.when(binary, F.array(F.struct(F.lit("binary").alias("pattern"), F.lit(1.0).alias("confidence")))).otherwise(found)


def primary(column: str | Column, **options) -> Column:
    """The pattern with the highest confidence (ties: the name that sorts first); null for a sound row."""
    order = F.transform(patterns(column, **options), lambda p: F.struct((-p["confidence"]).alias("c"), p["pattern"].alias("pattern")))
    return F.get(F.sort_array(order), F.lit(0))["pattern"]


def fix_encoding(c: Column) -> Column:
    return F.regexp_replace(c, "^\ufeff", "")


def from_bytes(column: str) -> Column:
    """Text of a binary column: UTF-8 where it is valid, else Latin-1."""
    return F.when(F.is_valid_utf8(F.col(column)), F.decode(F.col(column), "UTF-8")).otherwise(F.decode(F.col(column), "ISO-8859-1"))


def fix_quotes(c: Column) -> Column:
    """A closing quote for an odd number of them."""
    return F.when(count_of(c, '"') % 2 == 1, F.concat(c, F.lit('"'))).otherwise(c)


def fix_delimiter(c: Column, delimiter: str = ",") -> Column:
    """The most frequent other delimiter replaced, if it occurs more often than the right one and over twice."""
    out = c
    others = [d for d in DELIMITERS if d != delimiter]
    most = F.greatest(*[count_of(c, d) for d in others])
    for d in reversed(others):
        out = F.when((count_of(c, d) == most) & (most > count_of(c, delimiter)) & (most > 2), F.replace(c, F.lit(d), F.lit(delimiter))).otherwise(out)
    return out


def fix_newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def fix_nul(c: Column) -> Column:
    return F.replace(c, F.lit("\x00"), F.lit(""))


def fix_space(c: Column) -> Column:
    return F.trim(c)


def fix_escapes(c: Column) -> Column:
    """Known escapes resolved; a trailing backslash dropped."""
    known = reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), (("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r"), ('\\"', '"'), ("\\'", "'")), c)
    return F.regexp_replace(F.regexp_replace(known, r"\\$", ""), r"\\\\", r"\\")


def fix_entities(c: Column) -> Column:
    """Named entities and decimal ones of Latin-1."""
    named = reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), ENTITIES[:-1], c)
    codes = F.array_distinct(F.regexp_extract_all(named, F.lit(r"&#(\d{1,3});"), F.lit(1)))
    numbered = F.aggregate(F.filter(codes, lambda n: n.cast("int") < 256), named, lambda text, n: F.replace(text, F.concat(F.lit("&#"), n, F.lit(";")), F.char(n.cast("int"))))
    return F.replace(numbered, F.lit("&amp;"), F.lit("&"))


def fix_columns(c: Column, columns: int, delimiter: str = ",") -> Column:
    """Padded or cut to a number of fields."""
    fields = F.split(c, f"[{delimiter}]" if delimiter != "|" else "[|]")
    padded = F.concat(F.slice(fields, 1, columns), F.array_repeat(F.lit(""), F.greatest(F.lit(0), F.lit(columns) - F.size(fields))))
    return F.array_join(padded, delimiter)


def heal(column: str | Column, delimiter: str = ",", columns: int | None = None, rules: tuple[str, ...] = tuple(RULES)) -> Column:
    """The row with all the rules applied in order; the number of columns is only set where one is given."""
    c = F.col(column) if isinstance(column, str) else column
    steps = {
        "encoding": fix_encoding,
        "nul": fix_nul,
        "newlines": fix_newlines,
        "entities": fix_entities,
        "quotes": fix_quotes,
        "escapes": fix_escapes,
        "delimiter": lambda x: fix_delimiter(x, delimiter),
        "whitespace": fix_space,
        "columns": lambda x: fix_columns(x, columns, delimiter) if columns else x,
    }
    # a lambda's argument is made once, however often a rule reads it
    healed = reduce(lambda x, name: F.transform(x, steps[name]), [n for n in RULES if n in rules], F.array(c))
    return F.get(healed, F.lit(0))


def corpus_patterns(df: DataFrame, column: str, **options) -> DataFrame:
    """pattern, n_rows: how many rows show each pattern."""
    return df.select(F.explode(patterns(column, **options)).alias("p")).groupBy("p.pattern").agg(F.count(F.lit(1)).alias("n_rows"))


def recommended_rules(df: DataFrame, column: str, **options) -> DataFrame:
    """rule, n_rows of the rules that the patterns of a corpus ask for."""
    wanted = [(rule, pattern) for rule, found in RULES.items() for pattern in found]
    rules = df.sparkSession.createDataFrame(wanted, "rule string, pattern string")
    return corpus_patterns(df, column, **options).join(rules, "pattern").groupBy("rule").agg(F.sum("n_rows").alias("n_rows"))


def fix_statistics(df: DataFrame, column: str, **options) -> DataFrame:
    """n_rows, n_damaged, n_changed and n_fixed (damaged before, sound after)."""
    count = lambda c: F.size(patterns(c, **options))
    healed = df.select(F.col(column).alias("before"), heal(column, **options).alias("after"))
    return healed.select(count("before").alias("a"), count("after").alias("b"), (F.col("before") != F.col("after")).alias("changed")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("a") > 0).alias("n_damaged"), F.count_if("changed").alias("n_changed"), F.count_if((F.col("a") > 0) & (F.col("b") == 0)).alias("n_fixed")
    )


def split_errors(df: DataFrame, error: Column, name: str = "error") -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with their error): `error` is null for good rows."""
    marked = df.withColumn(name, error)
    return marked.where(F.col(name).isNull()).drop(name), marked.where(F.col(name).isNotNull())


def with_policy(df: DataFrame, error: Column, policy: str = "skip", max_errors: int | None = None) -> DataFrame:
    """Rows under an error policy: strict fails on the first bad row, skip drops them, quarantine keeps them apart (see split_errors) and recover keeps all."""
    if policy == "strict":
        return df.where(F.when(error.isNotNull(), F.raise_error(error).isNull()).otherwise(F.lit(True)))
    if policy == "recover":
        return df
    good, bad = split_errors(df, error)
    if max_errors is not None and bad.limit(max_errors + 1).count() > max_errors:
        raise ValueError(f"more than {max_errors} bad rows")
    return good
