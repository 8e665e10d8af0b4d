"""The case-centric event log: a DataFrame with fixed roles and a total order.

Columns: case_id string, activity string, timestamp long (nanoseconds since 1970), resource
string, seq long. Events of a case are in order of (timestamp, seq); seq breaks ties, so every
operator on sequences has one result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

ROLES = ("case_id", "activity", "timestamp", "resource", "seq")

#: Names by which columns are taken for a role, in order of preference.
ROLE_NAMES = {
    "case_id": ("case_id", "caseid", "case", "case:concept:name", "trace_id", "order_id", "orderid", "ticket_id", "user_id", "id"),
    "activity": ("activity", "concept:name", "event", "event_type", "action", "task", "step"),
    "timestamp": ("timestamp", "time:timestamp", "time", "datetime", "event_time", "ts", "created_at"),
    "resource": ("resource", "org:resource", "user", "agent", "performer", "assigned_to"),
}


def nanos(column: str | Column) -> Column:
    """A timestamp (with or without zone; session zone UTC) as nanoseconds."""
    c = F.col(column) if isinstance(column, str) else column
    return F.unix_micros(c.cast("timestamp")) * 1000


def as_timestamp(column: str | Column) -> Column:
    """Nanoseconds as a timestamp, cut to microseconds."""
    c = F.col(column) if isinstance(column, str) else column
    return F.timestamp_micros(F.call_function("div", c - F.pmod(c, F.lit(1000)), F.lit(1000)))


def detect_roles(columns: list[str]) -> dict[str, str]:
    """Role -> column: an exact name first, in the order of ROLE_NAMES, then the first column that contains a name."""
    lower = {c.lower(): c for c in reversed(columns)}
    roles: dict[str, str] = {}
    for role, names in ROLE_NAMES.items():
        found = next((lower[n] for n in names if n in lower), None) or next((c for n in names for c in columns if n in c.lower() and c not in roles.values()), None)
        if found:
            roles[role] = found
    return roles


def missing_roles(columns: list[str], required: tuple[str, ...] = ("case_id", "activity", "timestamp")) -> list[str]:
    """Required columns that a frame lacks, whatever their case."""
    have = {c.lower() for c in columns}
    return [r for r in required if r not in have]


def event_log(df: DataFrame, case_id: str | None = None, activity: str | None = None, timestamp: str | None = None, resource: str | None = None, seq: str | Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """The log of a frame whose roles are named or detected; `keep` names further columns to carry."""
    roles = detect_roles(df.columns)
    case_id, activity, timestamp = case_id or roles.get("case_id"), activity or roles.get("activity"), timestamp or roles.get("timestamp")
    if not (case_id and activity and timestamp):
        raise ValueError(f"no columns for the roles of case, activity and timestamp among {df.columns}")
    resource = resource or roles.get("resource")
    time = F.col(f"`{timestamp}`")
    kind = df.schema[timestamp].dataType.simpleString()
    order = seq if isinstance(seq, Column) else F.col(seq) if seq else F.lit(0)
    return df.select(
        F.col(f"`{case_id}`").cast("string").alias("case_id"),
        F.col(f"`{activity}`").cast("string").alias("activity"),
        (time.cast("long") if kind in ("bigint", "int") else nanos(time)).alias("timestamp"),
        (F.col(f"`{resource}`").cast("string") if resource else F.lit(None).cast("string")).alias("resource"),
        order.cast("long").alias("seq"),
        *[F.col(f"`{c}`") for c in keep or []],
    )


def in_case(*more: str) -> WindowSpec:
    """The window over a case in the log's order."""
    return Window.partitionBy("case_id", *more).orderBy("timestamp", "seq")


def traces(log: DataFrame) -> DataFrame:
    """case_id and trace, the activities of a case in order."""
    ordered = F.array_sort(F.collect_list(F.struct("timestamp", "seq", "activity")))
    return log.where("activity is not null").groupBy("case_id").agg(F.transform(ordered, lambda e: e["activity"]).alias("trace"))
