"""Appends: a job writes Parquet files by partition, and one commit makes them a part of the table.

Rows are validated as they are written; a bad row fails the job, and nothing is committed. Row ids cost no
shuffle and no numbering pass: a file's rows are numbered by their place in it, after a base that the commit
gives the file (a prefix sum over the segment's files) and that stands in its path.

A file a partition is too much work where partitions are many and small. There an append is packed: a task writes one
file, in order of the partitions, and the log has each segment's share of it.
"""

from __future__ import annotations

import datetime as dt
import re
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import unquote

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.errors import CommitConflict, Internal, InvalidRequest, TooManyRequests
from strata.functions.sharding import Shard, choose
from strata.functions.types import MAX_FIELD_BYTES, ROW_BYTES, holds_null, same_type, value_bytes
from strata.operators.catalog import Catalog
from strata.plans.log import Segment, State
from strata.plans.partitions import encoded, from_path_text, normal_path_value, path_text
from strata.plans.schema import WRITTEN_AT, TableSchema, packed_path

RETRIES = 20
#: An append to more partitions than this, with fewer rows each on average, shares files between them.
PACKED_PARTITIONS, PACKED_ROWS = 500, 10_000
#: Files of partitions that a write task has open at once, before it sorts the other partitions' rows.
OPEN_FILES = 4


_opening: dict = {"lock": threading.Lock(), "writes": 0, "before": None}


@contextmanager
def open_files(spark: SparkSession) -> Iterator[None]:
    """Within, a task writes its first partitions as their rows come. It would sort all its rows by partition otherwise, and
    a hot partition's rows from one input split can't be dealt to several tasks."""
    key = "spark.sql.maxConcurrentOutputFileWriters"
    with _opening["lock"]:
        if not _opening["writes"]:
            _opening["before"] = spark.conf.get(key, None)
            spark.conf.set(key, str(OPEN_FILES))
        _opening["writes"] += 1
    try:
        yield
    finally:
        with _opening["lock"]:
            _opening["writes"] -= 1
            if not _opening["writes"]:
                spark.conf.unset(key) if _opening["before"] is None else spark.conf.set(key, _opening["before"])


def partition_path(schema: TableSchema, partition: dict) -> str:
    return "/".join(f"{schema.path_column(n)}={path_text(d, partition[n])}" for n, d in schema.partitioning.items())


def prepared(schema: TableSchema, df: DataFrame, at: dt.datetime | None) -> DataFrame:
    """The rows as stored: declared columns, _written_at (a column of ``df`` if ``at`` isn't given), _bytes and path columns; bad rows raise in the job."""
    given = set(df.columns) - ({WRITTEN_AT} if at is None else set())
    if unknown := given - set(schema.user_columns()):
        raise InvalidRequest(f"unknown columns: {sorted(unknown)}")
    if missing := set(schema.partitioning) - given:
        raise InvalidRequest(f"missing partition fields: {sorted(missing)}")
    columns, sizes, checks = [], [], []
    for name, field in schema.columns.items():
        if name not in given:
            continue
        kind = df.schema[name].dataType
        if kind.typeName() != "void" and not same_type(kind, field.spark):
            raise InvalidRequest(f"column {name}: {kind.simpleString()} isn't {field.spark.simpleString()}")
        column = F.col(name) if kind.simpleString() == field.spark.simpleString() else F.col(name).cast(field.spark)
        size = value_bytes(F.col(name), field.dtype, field.nested_list_depth)
        columns.append(column.alias(name))
        sizes.append(size)
        if field.nested_list_depth or field.dtype in ("string", "bytes"):
            checks.append(F.when(size > MAX_FIELD_BYTES, F.lit(f"column {name} has a value over {MAX_FIELD_BYTES} bytes")))
        if field.nested_list_depth:
            checks.append(F.when(holds_null(F.col(name), field.nested_list_depth), F.lit(f"column {name} has a null in a list")))
    for name, dtype in schema.partitioning.items():
        wanted = {"bool": "boolean", "int64": "bigint", "string": "string", "timestampMinute": "timestamp"}[dtype]
        kind = df.schema[name].dataType.simpleString()
        if kind != wanted and not (wanted == "bigint" and kind in ("int", "smallint", "tinyint")):
            raise InvalidRequest(f"partition field {name}: {kind} isn't {wanted}")
    total = sum(sizes, F.lit(ROW_BYTES).cast("long"))
    if checks:
        wrong = F.coalesce(*checks)
        total = F.when(wrong.isNotNull(), F.raise_error(F.concat(F.lit("INVALID_ROW: "), wrong)).cast("long")).otherwise(total)
    paths = [encoded(schema, n, F.col(n).cast("long") if d == "int64" else F.col(n)).alias(schema.path_column(n)) for n, d in schema.partitioning.items()]
    return df.select(*columns, (F.col(WRITTEN_AT) if at is None else F.lit(at)).cast("timestamp").alias(WRITTEN_AT), total.alias("_bytes"), *paths)


def job_error(e: PySparkException) -> Exception:
    if found := re.search(r"INVALID_ROW: ([^\n\"]*)", str(e)):
        return InvalidRequest(found[1].split(" SQLSTATE")[0].rstrip(". "))
    if "Too many open files" in str(e):
        return TooManyRequests("too many open files")
    return e


class Part:
    """What an append adds to a segment."""

    def __init__(self, segment_id: str):
        self.segment_id, self.files, self.sources, self.packed, self.rows, self.size = segment_id, {}, {}, {}, 0, 0

    def add(self, key: str, path: str, base: int, n: int, size: int, shared: tuple[int, int] | None) -> None:
        if shared:
            start, total = shared
            target = packed_path(path.rsplit("/", 1)[1], total)
            self.packed[target] = [base, start]
        else:
            target = "/".join(x for x in (key, f"_segment_id={self.segment_id}", f"_base={base}", path.rsplit("/", 1)[1]) if x)
        self.files[target], self.sources[path] = n, target
        self.rows, self.size = self.rows + n, self.size + size


class Writer:
    def __init__(self, spark: SparkSession, catalog: Catalog, target_rows: int, target_bytes: int, shards_log: int):
        self.spark, self.catalog, self.store = spark, catalog, catalog.store
        self.target_rows, self.target_bytes, self.shards_log = target_rows, target_bytes, shards_log

    def write(self, table: str, df: DataFrame, stream: str | None = None, batch: int | None = None, layout: str = "rebalance", own_times: bool = False, journal: str | None = None, done: list[str] | None = None) -> dict:
        """Appends ``df``; of a stream, a batch that is committed already is skipped.

        All rows get one time of writing, unless ``own_times`` says that they bring theirs as ``_written_at``.
        ``journal`` has the staged writes that ``df`` holds: if a commit has taken it in, nothing is added; ``done`` are
        journals that are gone, which the log needn't know any more.

        ``layout="rebalance"`` brings a partition's rows together in few files, splitting hot partitions;
        ``"as_is"`` writes them where they are, without a shuffle.
        """
        state = self.catalog.state(table)
        if stream is not None and state.batches.get(stream, -1) >= batch:
            return {"rows": 0, "segments": []}
        at = dt.datetime.now(dt.UTC)
        rows = prepared(state.schema, df, None if own_times else at)
        paths = [state.schema.path_column(n) for n in state.schema.partitioning]
        staging = f"_tmp/{uuid.uuid4().hex}"
        try:
            packed = bool(paths) and layout == "rebalance" and self._small(rows, paths)
            if paths and layout == "rebalance":
                rows = rows.hint("rebalance", *[F.col(p) for p in paths])
            if packed:
                rows = rows.sortWithinPartitions(*paths)
            with open_files(self.spark):
                (rows.write.partitionBy(*paths) if paths and not packed else rows.write).option("compression", "zstd").option("maxRecordsPerFile", self.target_rows).parquet(self.store.uri(staging))
            files = self._packed(state.schema, staging) if packed else self._written(state.schema, staging, rows)
            return self._commit(table, files, at, stream, batch, {"journal": journal, "done": done})
        except PySparkException as e:
            raise job_error(e) from e
        finally:
            self.store.delete(staging)

    def _small(self, rows: DataFrame, paths: list[str]) -> bool:
        """Whether partitions are many and small; reads the partition columns only."""
        n, partitions = rows.agg(F.count("*"), F.approx_count_distinct(F.struct(*paths))).first()
        return partitions > PACKED_PARTITIONS and n < PACKED_ROWS * partitions

    def _packed(self, schema: TableSchema, staging: str) -> list[tuple[dict, str, int, int, tuple[int, int]]]:
        """Of each partition in each file what ``_written`` has, and its first row's place and the file's rows; a row each comes to the driver."""
        names = {p.rsplit("/", 1)[1]: p for p, _ in self.store.walk(staging) if p.endswith(".parquet")}
        if not names:
            return []
        kind = T.StructType([T.StructField("_bytes", T.LongType()), *schema.path_fields()])
        paths = [schema.path_column(n) for n in schema.partitioning]
        row = F.col("_metadata.row_index")
        read = self.spark.read.schema(kind).parquet(self.store.uri(staging))
        found = read.groupBy(F.col("_metadata.file_name").alias("name"), *paths).agg(F.count("*").alias("n"), F.sum("_bytes").alias("size"), F.min(row).alias("start"), F.max(row).alias("end")).collect()
        total: dict[str, int] = {}
        for name, *_, n, _, start, end in found:  # by place, as a lookup by name goes through all names
            if end - start + 1 != n:
                raise Internal(f"{name}: the rows of a partition aren't together")
            total[name] = total.get(name, 0) + n
        kinds = schema.partitioning.items()
        out = []
        for name, *own, n, size, start, _ in sorted(found, key=lambda r: (r[0], r[-2])):
            partition = {k: normal_path_value(d, v) for (k, d), v in zip(kinds, own, strict=True)}
            out.append((partition, names[name], n, size, (start, total[name])))
        return out

    def _written(self, schema: TableSchema, staging: str, rows: DataFrame) -> list[tuple[dict, str, int, int, None]]:
        """Of each file its partition, path, rows and accounted bytes; a row a file comes to the driver."""
        if not any(p.endswith(".parquet") for p, _ in self.store.walk(staging)):
            return []
        read = self.spark.read.schema("_bytes long").parquet(self.store.uri(staging))
        found = read.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("n"), F.sum("_bytes").alias("size")).collect()
        out = []
        for r in sorted(found, key=lambda r: r.path):
            path = unquote(r.path[r.path.index(staging) :])
            parts = dict(p.split("=", 1) for p in path.split("/")[2:-1])
            partition = {n: from_path_text(d, parts[schema.path_column(n)]) for n, d in schema.partitioning.items()}
            out.append((partition, path, r.n, r.size, None))
        return out

    def _commit(self, table: str, files: list, at: dt.datetime, stream: str | None, batch: int | None, staged: dict) -> dict:
        placed = {path: path for _, path, *_ in files}
        for _ in range(RETRIES):
            state = self.catalog.state(table)
            if stream is not None and state.batches.get(stream, -1) >= batch or staged["journal"] in state.batches:
                return {"rows": 0, "segments": []}
            commit = self.assign(state, files, at) | {k: v for k, v in staged.items() if v}
            commit |= {"stream": stream, "batch": batch} if stream is not None else {}
            for segment in commit["segments"]:
                for source, target in segment.pop("sources").items():
                    to = f"{table}/data/{target}"
                    if placed[source] != to:
                        self.store.rename(placed[source], to)
                        placed[source] = to
            try:
                self.catalog.log(table).commit(state, commit)
                return {"rows": sum(n for _, _, n, *_ in files), "segments": [s["segment_id"] for s in commit["segments"]]}
            except CommitConflict:
                continue
        raise CommitConflict(f"table {table}")

    def assign(self, state: State, files: list, at: dt.datetime) -> dict:
        """The append commit: each partition's files go to its active segment, or to a new one if that is full.

        An append stays in one segment, but for one that by itself fills several: each of these gets files up to the
        target, what the first holds already included, so that no segment, and no task that compacts it, grows with the size of an append.
        """
        by_partition: dict[str, list] = {}
        values: dict[str, dict] = {}
        for partition, path, n, size, shared in files:
            key = partition_path(state.schema, partition)
            values[key] = partition
            by_partition.setdefault(key, []).append((path, n, size, shared))
        segments, active = [], {}
        for key, own in by_partition.items():
            shard = choose(key, self.shards_log) if self.shards_log else Shard()
            slot = f"{key}#{shard.number}"
            segment = state.segments.get(state.active.get(slot, ""))
            if segment is None or self.cold(segment):
                segment = Segment(values[key], shard.new_segment_id())
                active[slot] = segment.segment_id
            base, parts = segment.all_time_n, [Part(segment.segment_id)]
            large = sum(n for _, n, _, _ in own) >= self.target_rows or sum(size for _, _, size, _ in own) >= self.target_bytes
            held, held_bytes = (segment.row_count, segment.uncompressed_bytes) if large else (0, 0)
            for path, n, size, shared in own:
                if parts[-1].rows + held >= self.target_rows or parts[-1].size + held_bytes >= self.target_bytes:
                    base, parts, held, held_bytes = 0, [*parts, Part(shard.new_segment_id())], 0, 0
                    active[slot] = parts[-1].segment_id
                parts[-1].add(key, path, base, n, size, shared)
                base += n
            segments += [{"partition": values[key], "segment_id": p.segment_id, "files": p.files, "sources": p.sources, "bytes": p.size} | ({"packed": p.packed} if p.packed else {}) for p in parts]
        return {"kind": "append", "at": at.timestamp(), "segments": segments, "active": active, "partitions": values}

    def cold(self, segment: Segment) -> bool:
        return segment.all_time_n >= self.target_rows + segment.deleted_n or segment.uncompressed_bytes >= self.target_bytes

    def register_partition(self, table: str, partition: dict) -> None:
        """An empty write makes the partition known, with a segment of no rows."""
        for _ in range(RETRIES):
            state = self.catalog.state(table)
            key = partition_path(state.schema, partition)
            if key in state.partitions:
                return
            shard = choose(key, self.shards_log) if self.shards_log else Shard()
            segment = shard.new_segment_id()
            commit = {
                "kind": "append", "at": dt.datetime.now(dt.UTC).timestamp(), "partitions": {key: partition}, "active": {f"{key}#{shard.number}": segment},
                "segments": [{"partition": partition, "segment_id": segment, "files": {}, "bytes": 0}],
            }
            try:
                self.catalog.log(table).commit(state, commit)
                return
            except CommitConflict:
                continue
        raise CommitConflict(f"table {table}")
