"""Table schemas: names, limits, JSON form and Spark types."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import types as T

from strata.errors import InvalidRequest
from strata.functions.types import MAX_LIST_DEPTH, PARTITION_SPARK, PARTITION_TYPES, PATH_TYPES, SPARK_TYPES, spark_type

MAX_COLUMNS, MAX_PARTITION_FIELDS, MAX_NAME_BYTES = 255, 4, 255
ROW_ID, WRITTEN_AT = "_row_id", "_written_at"
NAME = re.compile(r"[A-Za-z0-9_]+")


def packed_path(name: str, rows: int) -> str:
    """Below data/, of a file that several segments share; it has the path columns among its own."""
    return f"packed/{rows}-{name}"


def packed_rows(path: str) -> int:
    return int(path.removeprefix("packed/").split("-", 1)[0])


def check_name(what: str, name: str, creating: bool = True) -> None:
    if not isinstance(name, str) or not NAME.fullmatch(name) or len(name.encode()) > MAX_NAME_BYTES:
        raise InvalidRequest(f"{what} name {name!r} must be 1 to {MAX_NAME_BYTES} letters, digits or underscores")
    if creating and name.startswith("_"):
        raise InvalidRequest(f"{what} name {name!r} may not begin with an underscore")


@dataclass(frozen=True)
class Field:
    dtype: str
    nested_list_depth: int = 0

    @property
    def spark(self) -> T.DataType:
        return spark_type(self.dtype, self.nested_list_depth)

    def json(self) -> dict:
        return {"dtype": self.dtype, "nestedListDepth": self.nested_list_depth}


@dataclass
class TableSchema:
    """Columns in declared order, and partition fields (name to type) in name order."""

    columns: dict[str, Field] = field(default_factory=dict)
    partitioning: dict[str, str] = field(default_factory=dict)

    @staticmethod
    def parse(spec: TableSchema | dict | None) -> TableSchema:
        """From ``{"columns": {name: dtype | {"dtype", "nestedListDepth"}}, "partitioning": {name: dtype | {"dtype"}}}``."""
        if isinstance(spec, TableSchema):
            return spec
        if not isinstance(spec, dict):
            raise InvalidRequest("a schema is required")
        if unknown := set(spec) - {"columns", "partitioning"}:
            raise InvalidRequest(f"unknown schema keys: {sorted(unknown)}")
        kinds = {k: (v["dtype"] if isinstance(v, dict) else v) for k, v in (spec.get("partitioning") or {}).items()}
        return TableSchema(parse_columns(spec.get("columns") or {}), dict(sorted(kinds.items())))

    def json(self) -> dict:
        return {"columns": {k: v.json() for k, v in self.columns.items()}, "partitioning": {k: {"dtype": v} for k, v in self.partitioning.items()}}

    def validate(self) -> TableSchema:
        if len(self.columns) > MAX_COLUMNS:
            raise InvalidRequest(f"a table has at most {MAX_COLUMNS} columns")
        if len(self.partitioning) > MAX_PARTITION_FIELDS:
            raise InvalidRequest(f"a table has at most {MAX_PARTITION_FIELDS} partition fields")
        for name, column in self.columns.items():
            check_name("column", name)
            if column.dtype not in SPARK_TYPES:
                raise InvalidRequest(f"column {name}: unknown dtype {column.dtype!r}")
            if not 0 <= column.nested_list_depth <= MAX_LIST_DEPTH:
                raise InvalidRequest(f"column {name}: lists nest at most {MAX_LIST_DEPTH} deep")
        for name, dtype in self.partitioning.items():
            check_name("partition field", name)
            if dtype not in PARTITION_TYPES:
                raise InvalidRequest(f"partition field {name}: unknown dtype {dtype!r}")
        names = [n.lower() for n in (*self.columns, *self.partitioning)]
        if len(set(names)) < len(names):
            raise InvalidRequest("names of columns and partition fields must differ by more than case")
        return self

    def user_columns(self) -> list[str]:
        return [*self.columns, *self.partitioning]

    def path_column(self, name: str) -> str:
        return f"_p_{name}"

    def path_fields(self) -> list[T.StructField]:
        return [T.StructField(self.path_column(n), PATH_TYPES[d]) for n, d in self.partitioning.items()]

    def stored(self) -> T.StructType:
        """What data files may hold, with the columns that their paths give. Older files lack later columns."""
        own = [T.StructField(n, f.spark) for n, f in self.columns.items()]
        own += [T.StructField(ROW_ID, T.LongType()), T.StructField(WRITTEN_AT, T.TimestampType()), T.StructField("_bytes", T.LongType())]
        return T.StructType(own + self.path_fields() + [T.StructField("_segment_id", T.StringType()), T.StructField("_base", T.LongType())])

    def visible(self) -> T.StructType:
        own = [T.StructField(n, f.spark) for n, f in self.columns.items()]
        return T.StructType(own + [T.StructField(n, PARTITION_SPARK[d]) for n, d in self.partitioning.items()])


def parse_columns(spec: dict) -> dict[str, Field]:
    out = {}
    for name, v in spec.items():
        if isinstance(v, Field):
            out[name] = v
        elif isinstance(v, str):
            out[name] = Field(v)
        elif isinstance(v, dict) and set(v) <= {"dtype", "nestedListDepth"} and "dtype" in v:
            out[name] = Field(v["dtype"], int(v.get("nestedListDepth") or 0))
        else:
            raise InvalidRequest(f"column {name}: not a column")
    return out
