"""Comparing, merging and inferring schemas."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTEGERS = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType()]
_FLOATS = [T.FloatType(), T.DoubleType()]


def widens(old: T.DataType, new: T.DataType) -> bool:
    """Whether every value of the old type has its place in the new one: wider integers or floats, integers to floats, anything to text."""
    if old == new or isinstance(new, T.StringType):
        return True
    if old in _INTEGERS:
        return new in _FLOATS or (new in _INTEGERS and _INTEGERS.index(new) >= _INTEGERS.index(old))
    return old in _FLOATS and new in _FLOATS and _FLOATS.index(new) >= _FLOATS.index(old)


def wider(a: T.DataType, b: T.DataType) -> T.DataType:
    """The narrowest of the known types that holds both."""
    if widens(a, b):
        return b
    if widens(b, a):
        return a
    if a in _INTEGERS + _FLOATS and b in _INTEGERS + _FLOATS:
        return T.DoubleType()
    return T.StringType()


@dataclass(frozen=True)
class Change:
    column: str
    kind: str
    detail: str
    breaking: bool


def compare(old: T.StructType, new: T.StructType) -> list[Change]:
    """Columns added, removed, of another type or nullability; a change breaks readers of the old schema or not."""
    have, wanted = {f.name: f for f in old}, {f.name: f for f in new}
    out = [Change(n, "removed", f.dataType.simpleString(), True) for n, f in have.items() if n not in wanted]
    for n, f in wanted.items():
        if n not in have:
            out.append(Change(n, "added", f.dataType.simpleString(), not f.nullable))
            continue
        was = have[n]
        if was.dataType != f.dataType:
            out.append(Change(n, "type_changed", f"{was.dataType.simpleString()} -> {f.dataType.simpleString()}", not widens(was.dataType, f.dataType)))
        if was.nullable != f.nullable:
            out.append(Change(n, "nullability", f"{was.nullable} -> {f.nullable}", was.nullable))
    return sorted(out, key=lambda c: (c.column, c.kind))


def compatible(old: T.StructType, new: T.StructType) -> bool:
    return not any(c.breaking for c in compare(old, new))


def merge(old: T.StructType, new: T.StructType, policy: str = "strict") -> T.StructType:
    """strict: equal schemas only. merge_nullable: new columns come in nullable, none may go, types may widen. evolving: every column of both, nullable, in the wider type."""
    if policy == "strict":
        if compare(old, new):
            raise ValueError(f"schemas differ: {compare(old, new)}")
        return old
    have, wanted = {f.name: f for f in old}, {f.name: f for f in new}
    if policy == "merge_nullable":
        if gone := [n for n in have if n not in wanted]:
            raise ValueError(f"columns removed: {gone}")
        if bad := [n for n, f in have.items() if not widens(f.dataType, wanted[n].dataType) and not widens(wanted[n].dataType, f.dataType)]:
            raise ValueError(f"incompatible types: {bad}")
        kept = [T.StructField(n, wider(f.dataType, wanted[n].dataType), f.nullable or wanted[n].nullable) for n, f in have.items()]
        return T.StructType(kept + [T.StructField(n, f.dataType, True) for n, f in wanted.items() if n not in have])
    if policy == "evolving":
        names = [*have, *(n for n in wanted if n not in have)]
        return T.StructType([T.StructField(n, wider(have[n].dataType, wanted[n].dataType) if n in have and n in wanted else (have.get(n) or wanted[n]).dataType, True) for n in names])
    raise ValueError(f"unknown policy {policy!r}")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The frame in a schema: columns cast, missing ones null."""
    return df.select(*[(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])


def union(frames: list[DataFrame], policy: str = "evolving") -> DataFrame:
    """Frames with different schemas as one, in the merged schema."""
    schema = frames[0].schema
    for f in frames[1:]:
        schema = merge(schema, f.schema, policy)
    out = conform(frames[0], schema)
    for f in frames[1:]:
        out = out.unionByName(conform(f, schema))
    return out


@dataclass
class SchemaHistory:
    """Versions of a schema: each update merges by the policy and is a new version if it changes anything."""

    policy: str = "evolving"
    versions: list[T.StructType] = field(default_factory=list)

    def update(self, schema: T.StructType) -> int:
        merged = merge(self.versions[-1], schema, self.policy) if self.versions else schema
        if not self.versions or merged != self.versions[-1]:
            self.versions.append(merged)
        return len(self.versions)

    def version(self, number: int) -> T.StructType:
        return self.versions[number - 1]


def inferred(df: DataFrame, least: float = 0.5) -> T.StructType:
    """Types of the columns of a text frame by vote: the most frequent type of the values that are not null, the narrower of equals."""
    from eventloom.operators.quality import all_type_votes

    order = {"bool": T.BooleanType(), "int": T.LongType(), "float": T.DoubleType(), "timestamp": T.TimestampNTZType(), "string": T.StringType()}
    fields = []
    for c, votes in all_type_votes(df).items():
        if votes.get("float") and votes.get("int"):
            votes["float"] += votes.pop("int")
        best = max(order, key=lambda k: (votes.get(k, 0), -list(order).index(k)))
        fields.append(T.StructField(c, order[best] if votes.get(best) else T.StringType(), True))
    return T.StructType(fields)


def typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Text columns cast to a schema; null tokens and values that do not fit are null."""
    from eventloom.operators.quality import NULL_TOKENS

    def one(f: T.StructField) -> Column:
        c = F.trim(F.col(f.name))
        c = F.when(~c.isin(*NULL_TOKENS), c)
        if isinstance(f.dataType, T.BooleanType):
            return F.when(F.lower(c).isin("true", "yes", "1"), True).when(F.lower(c).isin("false", "no", "0"), False)
        return c.try_cast(f.dataType)

    return df.select(*[one(f).alias(f.name) for f in schema])
