"""Strict JSON rows: what doesn't fit its column's type is rejected, never turned into null."""

from __future__ import annotations

import base64
import binascii
import datetime as dt
import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.errors import InvalidRequest
from strata.functions.types import spark_type
from strata.plans.schema import Field, TableSchema

RFC3339 = re.compile(r"(\d{4}-\d\d-\d\d)[Tt ](\d\d:\d\d:\d\d)(\.\d+)?([Zz]|[+-]\d\d:\d\d)")
RFC3339_SQL = r"\A\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)\z"
INTEGER_SQL = r"\A-?(0|[1-9]\d*)\z"


def timestamp(text: str) -> dt.datetime:
    found = RFC3339.fullmatch(text) if isinstance(text, str) else None
    if not found:
        raise ValueError(text)
    day, clock, fraction, zone = found.groups()
    return dt.datetime.fromisoformat(f"{day}T{clock}{(fraction or '.0')[:7].ljust(7, '0')}{'+00:00' if zone in 'Zz' else zone}")


def value(name: str, x, field: Field, depth: int | None = None):
    depth = field.nested_list_depth if depth is None else depth
    if x is None:
        if depth < field.nested_list_depth:
            raise InvalidRequest(f"column {name}: a list holds a null")
        return None
    bad = InvalidRequest(f"column {name}: {x!r} is no {field.dtype} with list depth {field.nested_list_depth}")
    if depth:
        if not isinstance(x, list):
            raise bad
        out = [value(name, y, field, depth - 1) for y in x]
        if any(y is None for y in out):
            raise InvalidRequest(f"column {name}: a list holds a null")
        return out
    kind = field.dtype
    try:
        if kind == "bool" and isinstance(x, bool):
            return x
        if kind == "int64" and type(x) is int and -(1 << 63) <= x < 1 << 63:
            return x
        if kind in ("float32", "float64") and type(x) in (int, float):
            return float(x)
        if kind == "string" and isinstance(x, str):
            return x
        if kind == "bytes" and isinstance(x, str):
            return base64.b64decode(x, validate=True)
        if kind == "timestampMicros":
            return timestamp(x)
    except (ValueError, binascii.Error, OverflowError):
        raise bad from None
    raise bad


def rows(schema: TableSchema, body: str | bytes | list) -> list[tuple]:
    """Rows of a request, as tuples in column order; the first bad row rejects all."""
    if isinstance(body, (str, bytes)):
        try:
            body = json.loads(body if isinstance(body, str) else body.decode())
        except (UnicodeDecodeError, ValueError) as e:
            raise InvalidRequest(f"the body is no JSON: {e}") from None
    if not isinstance(body, list) or not all(isinstance(r, dict) for r in body):
        raise InvalidRequest("rows must be a list of objects")
    for r in body:
        if unknown := set(r) - set(schema.columns):
            raise InvalidRequest(f"unknown columns: {sorted(unknown)}")
    return [tuple(value(n, r.get(n), f) for n, f in schema.columns.items()) for r in body]


def json_frame(schema: TableSchema, df: DataFrame, column: str) -> DataFrame:
    """``df`` with the table's columns in place of its JSON column, as strict as ``rows`` and distributed; bad ones raise in the job.

    A first projection reads each object once: its keys, which of its values are quoted, and all scalars as raw text,
    which the second checks and casts. Lists keep Spark's parser with the element type, and must not come out null.
    """
    body = F.col(column)
    raw = T.StructType([T.StructField(n, T.StringType() if not f.nested_list_depth else spark_type(f.dtype if f.dtype not in ("bytes", "timestampMicros") else "string", f.nested_list_depth)) for n, f in schema.columns.items()])
    allowed = F.array(*[F.lit(n) for n in schema.columns])
    fail = lambda what: F.raise_error(F.concat(F.lit(f"INVALID_ROW: {what}: "), F.substring(body, 1, 200)))
    read = df.withColumns({
        "_keys": F.json_object_keys(body), "_quoted": F.regexp_extract_all(body, F.lit(r'"(\w+)"\s*:\s*"'), F.lit(1)),
        "_parsed": F.from_json(body, raw),
    })
    ok = F.col("_keys").isNotNull() & (F.size(F.array_except("_keys", allowed)) == 0)
    out = {}
    for n, f in schema.columns.items():
        text = F.col("_parsed")[n]
        given = F.array_contains("_keys", n) & text.isNotNull()
        if f.nested_list_depth:
            plain = F.get_json_object(body, f"$.{n}")
            bad, v = plain.isNotNull() & text.isNull(), text.cast(f.spark)
        else:
            quoted = F.array_contains("_quoted", n)
            if f.dtype == "string":
                good, v = quoted, text
            elif f.dtype == "int64":
                good, v = ~quoted & text.rlike(INTEGER_SQL), text.try_cast("bigint")
            elif f.dtype in ("float32", "float64"):
                good, v = ~quoted & text.rlike(r"\A-?[0-9]"), text.try_cast("float" if f.dtype == "float32" else "double")
            elif f.dtype == "bool":
                good, v = ~quoted & text.isin("true", "false"), text.try_cast("boolean")
            elif f.dtype == "bytes":
                good, v = quoted, F.try_to_binary(text, F.lit("base64"))
            else:
                good, v = quoted & text.rlike(RFC3339_SQL), text.try_cast("timestamp")
            bad = given & ~(good & v.isNotNull())
        out[n] = F.when(~ok, fail("not an object of the table's columns").cast(f.spark)).when(bad, fail(f"column {n}").cast(f.spark)).otherwise(v)
    others = [c for c in df.columns if c != column and c not in out]
    return read.select(*others, *(v.alias(n) for n, v in out.items()))
