"""Partition values, their path form, and filters on them."""

from __future__ import annotations

import datetime as dt
import re
import warnings
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from strata.errors import InvalidRequest
from strata.functions.time import epoch_minutes, whole_minute
from strata.plans.schema import TableSchema

TEXT = re.compile(r"[A-Za-z0-9_!*()\-]*")
TEXT_SQL = r"\A[A-Za-z0-9_!*()\-]*\z"
EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.UTC)
COMPARISONS = {
    "EqTo": lambda a, b: a == b,
    "Less": lambda a, b: a < b,
    "LessOrEqTo": lambda a, b: a <= b,
    "Greater": lambda a, b: a > b,
    "GreaterOrEqTo": lambda a, b: a >= b,
}


def normal(name: str, dtype: str, value):
    """A value as kept in the log: bool, int, str, or epoch minutes."""
    bad = InvalidRequest(f"partition field {name}: {value!r} is no {dtype}")
    if value is None:
        raise InvalidRequest(f"partition field {name} has no value")
    if dtype == "bool":
        if not isinstance(value, bool):
            raise bad
        return value
    if dtype == "int64":
        if isinstance(value, bool) or not isinstance(value, int) or not -(1 << 63) <= value < 1 << 63:
            raise bad
        return value
    if dtype == "string":
        if not isinstance(value, str):
            raise bad
        if not TEXT.fullmatch(value):
            raise InvalidRequest(f"partition field {name}: {value!r} has characters other than letters, digits and -_!*()")
        return value
    if isinstance(value, str):
        try:
            value = dt.datetime.fromisoformat(value)
        except ValueError:
            raise bad from None
    if not isinstance(value, dt.datetime) or value.tzinfo is None:
        raise bad
    minutes, rest = divmod(value - EPOCH, dt.timedelta(minutes=1))
    if rest:
        raise InvalidRequest(f"partition field {name}: {value} isn't a whole minute")
    return minutes


def normal_partition(schema: TableSchema, partition: dict | None) -> dict:
    partition = partition or {}
    if set(partition) != set(schema.partitioning):
        raise InvalidRequest(f"partition fields are {sorted(schema.partitioning)}, not {sorted(partition)}")
    return {n: normal(n, d, partition[n]) for n, d in schema.partitioning.items()}


def public_value(dtype: str, value):
    return EPOCH + dt.timedelta(minutes=value) if dtype == "timestampMinute" else value


def encoded(schema: TableSchema, name: str, column: Column) -> Column:
    """Column form of the path value; raises in the job for values that aren't allowed."""
    dtype = schema.partitioning[name]
    fail = lambda what: F.raise_error(F.lit(f"INVALID_ROW: partition field {name} {what}"))
    if dtype == "string":
        value = F.when(~column.rlike(TEXT_SQL), fail("has characters that aren't allowed")).otherwise(F.concat(F.lit("s~"), column))
    elif dtype == "timestampMinute":
        value = F.when(~whole_minute(column), fail("isn't a whole minute")).otherwise(epoch_minutes(column))
    else:
        value = column
    return F.when(column.isNull(), fail("has no value")).otherwise(value)


def decoded(schema: TableSchema, name: str) -> Column:
    """The public value of a path column; filters on it still prune partitions."""
    column, dtype = F.col(schema.path_column(name)), schema.partitioning[name]
    if dtype == "string":
        return F.substring(column, 3, 1 << 20)
    return F.timestamp_seconds(column * 60) if dtype == "timestampMinute" else column


def path_text(dtype: str, value) -> str:
    if dtype == "string":
        return "s~" + value.replace("*", "%2A")  # as Spark writes it; a star would be a pattern in a path
    return str(value).lower() if dtype == "bool" else str(value)


def from_path_text(dtype: str, text: str):
    if dtype == "string":
        return text[2:].replace("%2A", "*")
    return text == "true" if dtype == "bool" else int(text)


def normal_path_value(dtype: str, value):
    """From a path column's value, read from a file."""
    return value[2:] if dtype == "string" else value


def path_value(dtype: str, value):
    """Of a path column in a file."""
    return f"s~{value}" if dtype == "string" else value


@dataclass(frozen=True)
class PartitionFilter:
    """``name comparison value``; a filter without a value type (value_type None) passes everything."""

    name: str
    comparison: str
    value: object = None
    empty: bool = False


def check_filters(schema: TableSchema, filters: list[PartitionFilter] | None) -> list[tuple[str, str, object]]:
    """Filters ready to compare. Those on unknown fields are ignored with a warning; a comparison without value is invalid."""
    ready = []
    for f in filters or []:
        if f.empty:
            continue
        if f.value is None:
            raise InvalidRequest(f"partition filter on {f.name} has no value")
        if f.comparison not in COMPARISONS:
            raise InvalidRequest(f"unknown comparison {f.comparison!r}")
        if f.name not in schema.partitioning:
            warnings.warn(f"partition filter on unknown field {f.name!r} is ignored", stacklevel=3)
            continue
        ready.append((f.name, f.comparison, normal(f.name, schema.partitioning[f.name], f.value)))
    return ready


def passes(partition: dict, filters: list[tuple[str, str, object]]) -> bool:
    return all(COMPARISONS[c](_order(partition[n]), _order(v)) for n, c, v in filters)


def _order(value):
    return value.encode() if isinstance(value, str) else value
