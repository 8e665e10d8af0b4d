"""Filters and projections on logs and tables, built as Catalyst predicates."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """Keep (or, if `exclude`, drop) rows whose field compares as told; a missing value compares as empty."""

    field: str
    operator: str
    value: str = ""
    exclude: bool = False


def _matches(rule: Rule) -> Column:
    c = F.coalesce(F.col(rule.field).cast("string"), F.lit(""))
    tests = {
        "eq": lambda: c == rule.value,
        "ne": lambda: c != rule.value,
        "contains": lambda: c.contains(rule.value),
        "prefix": lambda: c.startswith(rule.value),
        "suffix": lambda: c.endswith(rule.value),
        "regex": lambda: c.rlike(rule.value),
        "empty": lambda: c == "",
        "notempty": lambda: c != "",
    }
    return tests.get(rule.operator, lambda: F.lit(False))()


def by_rules(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Rows that pass every rule."""
    return reduce(lambda d, r: d.where(~_matches(r) if r.exclude else _matches(r)), rules, df)


@dataclass
class Where:
    """Conditions joined by AND: Where().add("a", ">", 1).add("b", "in", [1, 2]).column()."""

    conditions: list[tuple[str, str, Any]] = field(default_factory=list)

    def add(self, column: str, operator: str, value: Any = None) -> Where:
        self.conditions.append((column, operator, value))
        return self

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, [c for x in self.conditions if (c := condition(*x)) is not None], F.lit(True))


def condition(column: str, operator: str, value: Any = None) -> Column | None:
    """One condition; None for an IN without values or a BETWEEN without two, which say nothing."""
    c, op = F.col(column), operator.upper()
    simple = {"=": lambda: c == value, "!=": lambda: c != value, "<>": lambda: c != value, "<": lambda: c < value, ">": lambda: c > value, "<=": lambda: c <= value, ">=": lambda: c >= value}
    if op in simple:
        return simple[op]()
    if op == "LIKE":
        return c.like(value)
    if op == "IN":
        return c.isin(list(value)) if value else None
    if op == "BETWEEN":
        return c.between(value[0], value[1]) if value is not None and len(value) >= 2 else None
    if op == "IS NULL":
        return c.isNull()
    if op == "IS NOT NULL":
        return c.isNotNull()
    raise ValueError(f"unknown operator {operator!r}")


def select(df: DataFrame, columns: list[str] | None = None, where: Where | str | None = None, limit: int | None = None) -> DataFrame:
    """Projection, filter and limit, which Catalyst pushes to the scan."""
    if where is not None:
        df = df.where(where.column() if isinstance(where, Where) else where)
    if columns:
        df = df.select(*columns)
    return df.limit(limit) if limit is not None else df


def time_range(df: DataFrame, column: str, start: Any, end: Any) -> DataFrame:
    """Rows with a time from `start` to `end`, both included."""
    return df.where(F.col(column).between(start, end))


def derive(df: DataFrame, name: str, rules: list[tuple[str, str]], otherwise: str | None = None) -> DataFrame:
    """A column that has the value of the first rule (SQL condition, value) that holds."""
    first = reduce(lambda c, r: c.when(F.expr(r[0]), r[1]), rules[1:], F.when(F.expr(rules[0][0]), rules[0][1]))
    return df.withColumn(name, first.otherwise(otherwise))


@dataclass(frozen=True)
class Profile:
    """A saved projection: roles by column, and which other columns to keep or leave."""

    mapping: dict[str, str]
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()

    def apply(self, df: DataFrame) -> DataFrame:
        rest = [c for c in df.columns if c not in self.mapping.values() and (not self.include or c in self.include) and c not in self.exclude]
        return df.select(*[F.col(c).alias(role) for role, c in self.mapping.items()], *rest)
