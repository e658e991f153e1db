"""``spark.read.format("strata").option("path", root).option("table_name", name).load()``.

The newest snapshot of a table of an engine at ``root``: data columns, then partition fields. A task reads a file;
files are pruned by the comparisons on partition fields that Spark offers.
Readers run in Python workers and open files themselves, so ``root`` must be a local or mounted folder there.
``Engine.table`` reads through Spark's own Parquet scan, prunes columns and is faster; this is for those who have
a path and no engine. Rows that are staged in another process are not seen before they are flushed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from strata.errors import InvalidRequest
from strata.functions.types import PARTITION_SPARK
from strata.plans.log import Log, State
from strata.plans.partitions import COMPARISONS, PartitionFilter, check_filters, passes, public_value
from strata.plans.schema import ROW_ID
from strata.plans.store import LocalStore
from strata.shipping import ship

PUSHED = {ds.EqualTo: "EqTo", ds.LessThan: "Less", ds.LessThanOrEqual: "LessOrEqTo", ds.GreaterThan: "Greater", ds.GreaterThanOrEqual: "GreaterOrEqTo"}


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and has Spark offer its filters to sources in Python."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TableSource)


@dataclass
class Share:
    """A segment's rows in a file: their first place in it, its id, and how many."""

    start: int
    base: int
    rows: int
    values: dict
    segment_id: str
    deletes: list[str]


@dataclass
class FilePart(ds.InputPartition):
    path: str
    shares: list[Share]


class TableSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "strata"

    def _open(self) -> tuple[LocalStore, str, State]:
        root, table = self.options.get("path"), self.options.get("table_name")
        if not root or not table:
            raise InvalidRequest("options path and table_name are required")
        parsed = urlparse(root)
        if parsed.scheme not in ("", "file"):
            raise InvalidRequest(f"{root}: only local and mounted folders can be read so; use Engine.table")
        store = LocalStore(unquote(parsed.path) if parsed.scheme else root)
        return store, table, Log(store, table).state()

    def schema(self) -> T.StructType:
        schema = self._open()[2].schema
        return T.StructType([T.StructField(n, f.spark) for n, f in schema.columns.items()] + [T.StructField(n, PARTITION_SPARK[d]) for n, d in schema.partitioning.items()])

    def reader(self, schema: T.StructType) -> ds.DataSourceReader:
        return TableReader(*self._open(), schema)


class TableReader(ds.DataSourceReader):
    def __init__(self, store: LocalStore, table: str, state: State, schema: T.StructType):
        self.root, self.table, self.state, self.schema = store.root, table, state, schema
        self.filters: list[PartitionFilter] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:  # noqa: N802  Spark's name
        """Comparisons on partition fields prune files; Spark applies all filters again to what is left."""
        for f in filters:
            if type(f) in PUSHED and len(f.attribute) == 1 and f.attribute[0] in self.state.schema.partitioning and PUSHED[type(f)] in COMPARISONS:
                own = PartitionFilter(f.attribute[0], PUSHED[type(f)], f.value)
                try:
                    check_filters(self.state.schema, [own])
                    self.filters.append(own)
                except InvalidRequest:  # of another type, or not a whole minute; Spark filters
                    pass
            yield f

    def partitions(self) -> list[FilePart]:
        ready, kinds = check_filters(self.state.schema, self.filters), self.state.schema.partitioning
        parts: dict[str, FilePart] = {}
        for s in self.state.segments.values():
            if passes(s.partition, ready):
                values = {c: public_value(d, s.partition[c]) for c, d in kinds.items()}
                for path, n in s.files.items():
                    base, start = s.packed[path] if path in s.packed else (int(re.search(r"_base=(\d+)/", path)[1]), 0)
                    parts.setdefault(path, FilePart(path, [])).shares.append(Share(start, base, n, values, s.segment_id, list(s.deletes)))
        for part in parts.values():
            part.shares.sort(key=lambda x: x.start)
        return list(parts.values())

    def _gone(self, share: Share) -> np.ndarray:
        found = [np.zeros(0, np.int64)]
        for path in share.deletes:
            found.append(pq.read_table(f"{self.root}/{self.table}/deletes/{path}", columns=["_row_id"], filters=[("_segment_id", "=", share.segment_id)])["_row_id"].to_numpy())
        return np.concatenate(found)

    def read(self, part: FilePart) -> Iterator[pa.RecordBatch]:
        wanted = to_arrow_schema(self.schema)
        with pq.ParquetFile(f"{self.root}/{self.table}/data/{part.path}", coerce_int96_timestamp_unit="us") as file:
            there, at, shares = set(file.schema_arrow.names), 0, iter(part.shares)
            share = next(shares)
            gone = self._gone(share)
            names = [n for n in [*wanted.names, ROW_ID] if n in there]
            for batch in file.iter_batches(columns=names):
                end = at + batch.num_rows
                while share is not None and share.start < end:
                    low, high = max(at, share.start), min(end, share.start + share.rows)
                    if low < high:
                        yield self._rows(batch.slice(low - at, high - low), wanted, share, gone, share.base + low - share.start)
                    if share.start + share.rows > end:
                        break
                    share = next(shares, None)
                    gone = self._gone(share) if share else gone
                at = end

    def _rows(self, batch: pa.RecordBatch, wanted: pa.Schema, share: Share, gone: np.ndarray, base: int) -> pa.RecordBatch:
        n, columns, there = batch.num_rows, [], set(batch.schema.names)
        for f in wanted:
            if f.name in share.values:
                columns.append(pa.array([share.values[f.name]] * n, f.type))
            elif f.name not in there:
                columns.append(pa.nulls(n, f.type))
            else:
                column = batch.column(f.name)
                column = column.cast(pa.timestamp("us")).cast(f.type) if pa.types.is_timestamp(column.type) and column.type.tz is None else column
                columns.append(column.cast(f.type))
        out = pa.RecordBatch.from_arrays(columns, schema=wanted)
        if len(gone):
            ids = np.arange(base, base + n)
            if ROW_ID in there and batch.column(ROW_ID).null_count < n:
                ids = batch.column(ROW_ID).to_numpy(zero_copy_only=False)
            out = out.filter(pa.array(~np.isin(ids, gone)))
        return out
