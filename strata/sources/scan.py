"""Reads: a snapshot's files as one Parquet scan, less the deleted rows.

Files are pruned by partition filters on the driver, and again by Catalyst where a query filters the decoded
partition columns. Segments without deletes are scanned as they are; only the others meet the delete vectors in
an anti join, which broadcasts these while they are few by the log's counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.plans.log import Segment, State
from strata.plans.partitions import decoded, path_value
from strata.plans.schema import ROW_ID, WRITTEN_AT, packed_rows
from strata.plans.store import HadoopStore, LocalStore

#: Delete vectors of at most this many row ids are broadcast: 60 bytes each at most.
BROADCAST_DELETES = 500_000
#: Segments' shares in packed files that are broadcast: some 150 bytes each.
BROADCAST_SHARES = 100_000
#: Files of a snapshot that the driver looks up itself.
DRIVER_LISTING = 512
DELETE_SCHEMA = "_segment_id string, _row_id long"


def _open(spark: SparkSession, schema: T.StructType, base: str, paths: list[str]) -> DataFrame:
    """The files as one scan. Some hundreds are looked up from the driver; for more, Spark runs a job of its own."""
    key = "spark.sql.sources.parallelPartitionDiscovery.threshold"
    before = spark.conf.get(key)
    try:
        if int(before) < len(paths) <= DRIVER_LISTING:
            spark.conf.set(key, str(DRIVER_LISTING))
        return spark.read.schema(schema).option("basePath", base).parquet(*paths)
    finally:
        spark.conf.set(key, before)


def _files(spark: SparkSession, store: LocalStore | HadoopStore, table: str, state: State, segments: list[Segment], with_ids: bool) -> DataFrame:
    """User columns, then _segment_id, _row_id and _written_at where asked for."""
    schema = state.schema
    stored = T.StructType([f for f in schema.stored() if f.name != "_bytes"])
    paths = [store.uri(f"{table}/data/{p}") for s in segments for p in s.files if p not in s.packed]
    columns = [F.col(n) for n in schema.columns] + [decoded(schema, n).alias(n) for n in schema.partitioning]
    parts = []
    if paths:
        rows = _open(spark, stored, store.uri(f"{table}/data"), paths)
        row_id = F.coalesce(F.col(ROW_ID), F.col("_base") + F.col("_metadata.row_index"))
        extra = [F.col("_segment_id"), row_id.alias(ROW_ID), F.col(WRITTEN_AT)] if with_ids else []
        parts.append(rows.select(*columns, *extra))
    if any(s.packed for s in segments):
        rows = _packed(spark, store, table, state, segments, with_ids)
        parts.append(rows.select(*columns, *(["_segment_id", ROW_ID, WRITTEN_AT] if with_ids else [])))
    if not parts:
        rows = spark.createDataFrame([], stored)
        parts.append(rows.select(*columns, *(["_segment_id", ROW_ID, WRITTEN_AT] if with_ids else [])))
    return reduce(DataFrame.unionByName, parts)


def _packed(spark: SparkSession, store: LocalStore | HadoopStore, table: str, state: State, segments: list[Segment], with_ids: bool) -> DataFrame:
    """The segments' shares of files that others have rows in too. Files that are wanted whole, without ids, are read as they are."""
    schema = state.schema
    kind = T.StructType([f for f in schema.stored() if f.name not in ("_bytes", ROW_ID, "_segment_id", "_base")])
    wanted: dict[str, int] = {}
    for s in segments:
        for p in s.packed:
            wanted[p] = wanted.get(p, 0) + s.files[p]
    whole = set() if with_ids else {p for p, n in wanted.items() if n == packed_rows(p)}
    read = lambda paths: _open(spark, kind, store.uri(f"{table}/data"), [store.uri(f"{table}/data/{p}") for p in sorted(paths)])
    parts = [read(whole)] if whole else []
    if rest := set(wanted) - whole:
        names = {n: schema.path_column(n) for n in schema.partitioning}
        shares = [
            (p.rsplit("/", 1)[1], s.segment_id, base - start, *(path_value(d, s.partition[n]) for n, d in schema.partitioning.items()))
            for s in segments for p, (base, start) in s.packed.items() if p in rest
        ]
        own = T.StructType([T.StructField("_file", T.StringType()), T.StructField("_segment_id", T.StringType()), T.StructField("_shift", T.LongType()), *schema.path_fields()])
        of = spark.createDataFrame(shares, own)
        rows = read(rest)
        for i, c in enumerate(names.values()):  # passes row groups over, as the rows are in this order
            rows = rows.where(F.col(c).between(F.lit(min(x[3 + i] for x in shares)), F.lit(max(x[3 + i] for x in shares))))
        rows = rows.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_index"))
        rows = rows.join(F.broadcast(of) if len(shares) <= BROADCAST_SHARES else of, ["_file", *names.values()])
        parts.append(rows.select(*kind.names, *(["_segment_id", (F.col("_index") + F.col("_shift")).alias(ROW_ID)] if with_ids else [])))
    return reduce(DataFrame.unionByName, parts)


def deletes(spark: SparkSession, store: LocalStore | HadoopStore, table: str, segments: list[Segment]) -> DataFrame:
    """Row ids deleted and not yet compacted away: (_segment_id, _row_id)."""
    paths = sorted({p for s in segments for p in s.deletes})
    if not paths:
        return spark.createDataFrame([], DELETE_SCHEMA)
    found = spark.read.schema(DELETE_SCHEMA).parquet(*[store.uri(f"{table}/deletes/{p}") for p in paths])
    own = sorted(s.segment_id for s in segments if s.deletes)
    return found.where(F.col("_segment_id").isin(own)) if len(own) <= 1000 else found


def scan(spark: SparkSession, store: LocalStore | HadoopStore, table: str, state: State, segments: list[Segment], with_ids: bool = False) -> DataFrame:
    clean = [s for s in segments if not s.deletes]
    marked = [s for s in segments if s.deletes]
    parts = [_files(spark, store, table, state, clean, with_ids)] if clean or not marked else []
    if marked:
        gone = deletes(spark, store, table, marked)
        ids = sum({p: n for s in marked for p, n in s.deletes.items()}.values())
        gone = F.broadcast(gone) if ids <= BROADCAST_DELETES else gone
        rows = _files(spark, store, table, state, marked, True).join(gone, ["_segment_id", ROW_ID], "left_anti")
        names = state.schema.user_columns() + (["_segment_id", ROW_ID, WRITTEN_AT] if with_ids else [])
        parts.append(rows.select(*names))
    return reduce(DataFrame.unionByName, parts)
