"""Column and partition types, and the accounted size of values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_LIST_DEPTH, MAX_FIELD_BYTES = 3, 4096

SPARK_TYPES: dict[str, T.DataType] = {
    "bool": T.BooleanType(),
    "bytes": T.BinaryType(),
    "float32": T.FloatType(),
    "float64": T.DoubleType(),
    "int64": T.LongType(),
    "string": T.StringType(),
    "timestampMicros": T.TimestampType(),
}
#: Types whose values seldom repeat, so that compaction stores them without dictionaries: integers and times as
#: differences, strings and bytes are left to Parquet's choice.
PLAIN_TYPES = ("int64", "float32", "float64", "timestampMicros")
#: Accounted bytes of a value; strings and bytes add their length.
VALUE_BYTES = {"bool": 1, "bytes": 2, "float32": 4, "float64": 8, "int64": 8, "string": 2, "timestampMicros": 12}
PARTITION_TYPES = ("bool", "int64", "string", "timestampMinute")
#: Spark's type of the encoded partition value in a path.
PATH_TYPES: dict[str, T.DataType] = {"bool": T.BooleanType(), "int64": T.LongType(), "string": T.StringType(), "timestampMinute": T.LongType()}
PARTITION_SPARK: dict[str, T.DataType] = {"bool": T.BooleanType(), "int64": T.LongType(), "string": T.StringType(), "timestampMinute": T.TimestampType()}
#: The two columns that every row has besides its own.
ROW_BYTES = 8 + 12


def spark_type(dtype: str, depth: int = 0) -> T.DataType:
    kind = SPARK_TYPES[dtype]
    for _ in range(depth):
        kind = T.ArrayType(kind)  # nulls inside are rejected on write
    return kind


def same_type(given: T.DataType, wanted: T.DataType) -> bool:
    """Whether a DataFrame's column may be stored as ``wanted``: equal but for nullability, or a narrower integer."""
    if isinstance(given, T.ArrayType) and isinstance(wanted, T.ArrayType):
        return same_type(given.elementType, wanted.elementType)
    if isinstance(wanted, T.LongType):
        return isinstance(given, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))
    return type(given) is type(wanted)


def value_bytes(column: Column, dtype: str, depth: int = 0) -> Column:
    """Accounted bytes of a value as a long; a null counts 0."""
    if depth:
        total = F.aggregate(column, F.lit(2).cast("long"), lambda n, x: n + value_bytes(x, dtype, depth - 1))
    elif dtype in ("string", "bytes"):
        total = (F.octet_length(column) + VALUE_BYTES[dtype]).cast("long")
    else:
        total = F.lit(VALUE_BYTES[dtype]).cast("long")
    return F.when(column.isNull(), F.lit(0).cast("long")).otherwise(total)


def accounted(x, dtype: str, depth: int = 0) -> int:
    """The same of a Python value."""
    if x is None:
        return 0
    if depth:
        return 2 + sum(accounted(y, dtype, depth - 1) for y in x)
    return VALUE_BYTES[dtype] + (len(x.encode()) if dtype == "string" else len(x) if dtype == "bytes" else 0)


def holds_null(column: Column, depth: int) -> Column:
    """Whether a list has a null inside, at any level."""
    if depth == 0:
        return F.lit(False)
    inner = F.exists(column, lambda x: x.isNull() | holds_null(x, depth - 1) if depth > 1 else x.isNull())
    return F.coalesce(inner, F.lit(False))
