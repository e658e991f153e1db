"""The engine's queries over the test tables, and the SQL to hold each against.

Tables are built once a session and input folder, in the shared folder that the cluster names or, without
one, in a temporary folder that goes at exit. Queries that change a table build their own.
"""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid
import warnings
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.config import options
from strata.engine import Engine, utc
from strata.errors import CommitConflict, Corrupt, InvalidRequest, NotFound, StrataError, TooManyRequests
from strata.functions.sharding import Shard, choose, shard_column, shard_of
from strata.functions.time import instant, time_bucket, whole_minute, zone_free
from strata.functions.types import MAX_FIELD_BYTES, holds_null, value_bytes
from strata.operators.maintain import Settings, due
from strata.plans.log import Segment
from strata.plans.partitions import TEXT_SQL, PartitionFilter
from strata.sources.datasource import register
from strata.sources.rest import answer
from strata.streaming.generator import EVENTS, METRICS, publish, random_rows
from strata.streaming.ingest import ingest, progress_rows

EVENT_COLUMNS = {"event_id": "int64", "ts": "timestampMicros", "user_id": "int64", "value": "float64", "props": "string"}
BY_TYPE_AND_DAY = {"event_type": "string", "day": "timestampMinute"}

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
_built: dict[tuple, Engine] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def scratch(spark: SparkSession) -> str:
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/strata-{uuid.uuid4().hex}"
    if not spark.sparkContext._jsc.sc().isLocal():
        raise InvalidRequest("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="strata-warehouse-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their instants, and the day they fall on in UTC."""
    ts = instant(F.col("ts"))
    day = F.timestamp_seconds(F.floor(F.unix_micros(ts) / F.lit(86_400_000_000)) * 86_400)
    return source(spark, sf_dir, "events").select("event_id", ts.alias("ts"), "user_id", "event_type", "value", "props", day.alias("day"))


def built(spark: SparkSession, sf_dir: str, what: str, build: Callable[[Engine], None]) -> Engine:
    key = (spark.sparkContext.applicationId, sf_dir, what)
    if key not in _built:
        engine = Engine(spark, scratch(spark))
        build(engine)
        _built[key] = engine
    return _built[key]


def event_table(spark: SparkSession, sf_dir: str) -> Engine:
    """Table ``events`` by type and day."""

    def build(engine: Engine) -> None:
        engine.create_table("events", {"columns": EVENT_COLUMNS, "partitioning": BY_TYPE_AND_DAY})
        engine.write("events", events(spark, sf_dir))

    return built(spark, sf_dir, "events", build)


def flat_table(spark: SparkSession, df: DataFrame, columns: dict, partitioning: dict | None = None, **options) -> Engine:
    """A fresh engine with one table ``t``."""
    engine = Engine(spark, scratch(spark), **options)
    engine.create_table("t", {"columns": columns, "partitioning": partitioning or {}})
    engine.write("t", df)
    return engine


EVENTS_SQL = "select event_id, ts, user_id, event_type, value, props from events"


def as_events(df: DataFrame) -> DataFrame:
    return df.select("event_id", zone_free(F.col("ts")).alias("ts"), "user_id", "event_type", "value", "props")


# reads


@query("select event_type, count(*) as n, cast(sum(cast(round(value * 100) as bigint)) as bigint) as cents from events group by event_type")
def events_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    event_table(spark, sf_dir).view("events", "strata_events")
    return spark.sql("select event_type, count(*) as n, sum(cast(round(value * 100) as bigint)) as cents from strata_events group by event_type")


@query("select count(*) as n from events")
def sql_count_star(spark, sf_dir):
    event_table(spark, sf_dir).view("events", "strata_events")
    return spark.sql("select count(*) as n from strata_events")


@query(f"{EVENTS_SQL} where event_id % 10 <> 0 and event_type <> 'click'")
def read_format(spark, sf_dir):
    """By Spark's reader, from a path and a table's name; rows deleted, and some compacted away."""
    e = flat_table(spark, events(spark, sf_dir).drop("day"), EVENT_COLUMNS, {"event_type": "string"})
    e.delete_where("t", "event_id % 20 = 0")
    e.compact("t", force=True)
    e.delete_where("t", "event_id % 10 = 0")
    register(spark)
    rows = spark.read.format("strata").option("path", e.store.uri("").rstrip("/")).option("table_name", "t").load()
    return as_events(rows.where("event_type <> 'click'"))


@query("select count(*) as n from events")
def scan_count(spark, sf_dir):
    return event_table(spark, sf_dir).table("events").agg(F.count("*").alias("n"))


@query("select count(*) as n from events")
def manifest_count(spark, sf_dir):
    return spark.createDataFrame([(event_table(spark, sf_dir).row_count("events"),)], "n long")


@query(EVENTS_SQL)
def write_roundtrip(spark, sf_dir):
    return as_events(event_table(spark, sf_dir).table("events"))


@query("select event_id, value from events")
def scan_project(spark, sf_dir):
    return event_table(spark, sf_dir).table("events").select("event_id", "value")


def _filtered(spark, sf_dir, *filters: tuple) -> DataFrame:
    return as_events(event_table(spark, sf_dir).table("events", [PartitionFilter(*f) for f in filters]))


@query(f"{EVENTS_SQL} where event_type = 'purchase'")
def partition_eq(spark, sf_dir):
    return _filtered(spark, sf_dir, ("event_type", "EqTo", "purchase"))


@query(f"{EVENTS_SQL} where date_trunc('day', ts) < timestamp '2024-01-10'")
def partition_lt(spark, sf_dir):
    return _filtered(spark, sf_dir, ("day", "Less", utc(2024, 1, 10)))


@query(f"{EVENTS_SQL} where date_trunc('day', ts) <= timestamp '2024-01-10'")
def partition_le(spark, sf_dir):
    return _filtered(spark, sf_dir, ("day", "LessOrEqTo", utc(2024, 1, 10)))


@query(f"{EVENTS_SQL} where date_trunc('day', ts) > timestamp '2024-01-10'")
def partition_gt(spark, sf_dir):
    return _filtered(spark, sf_dir, ("day", "Greater", utc(2024, 1, 10)))


@query(f"{EVENTS_SQL} where date_trunc('day', ts) >= timestamp '2024-01-10'")
def partition_ge(spark, sf_dir):
    return _filtered(spark, sf_dir, ("day", "GreaterOrEqTo", utc(2024, 1, 10)))


@query(f"{EVENTS_SQL} where date_trunc('day', ts) >= timestamp '2024-01-10' and date_trunc('day', ts) < timestamp '2024-01-15'")
def partition_and(spark, sf_dir):
    return _filtered(spark, sf_dir, ("day", "GreaterOrEqTo", utc(2024, 1, 10)), ("day", "Less", utc(2024, 1, 15)))


@query(f"{EVENTS_SQL} where event_type = 'click' and date_trunc('day', ts) between timestamp '2024-01-05' and timestamp '2024-01-08'")
def partition_prune_multi(spark, sf_dir):
    return _filtered(spark, sf_dir, ("event_type", "EqTo", "click"), ("day", "GreaterOrEqTo", utc(2024, 1, 5)), ("day", "LessOrEqTo", utc(2024, 1, 8)))


@query("select event_id, value from events where event_type = 'click' and date_trunc('day', ts) < timestamp '2024-01-08'")
def partition_prune_sql(spark, sf_dir):
    event_table(spark, sf_dir).view("events", "strata_events")
    return spark.sql("select event_id, value from strata_events where event_type = 'click' and unix_seconds(day) < 1704672000")


@query(EVENTS_SQL)
def partition_unknown_field(spark, sf_dir):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return _filtered(spark, sf_dir, ("no_such_field", "EqTo", "x"))


@query("select event_id, user_id from events where user_id >= 100 and user_id < 120")
def partition_int64(spark, sf_dir):
    def build(e):
        e.create_table("t", {"columns": {"event_id": "int64"}, "partitioning": {"user_id": "int64"}})
        e.write("t", events(spark, sf_dir).select("event_id", "user_id"))

    e = built(spark, sf_dir, "by_user", build)
    return e.table("t", [PartitionFilter("user_id", "GreaterOrEqTo", 100), PartitionFilter("user_id", "Less", 120)])


@query("select event_id, value, value > 100 as large from events where value > 100")
def partition_bool(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", "value", (F.col("value") > 100).alias("large"))
    e = flat_table(spark, rows, {"event_id": "int64", "value": "float64"}, {"large": "bool"})
    return e.table("t", [PartitionFilter("large", "EqTo", True)])


@query("select event_type, date_trunc('day', ts) as day, count(*) as row_count from events group by all")
def list_segments_row_count(spark, sf_dir):
    found = event_table(spark, sf_dir).segments_frame("events")
    return found.groupBy("event_type", zone_free(F.col("day")).alias("day")).agg(F.sum("row_count").alias("row_count"))


@query("select event_type, date_trunc('day', ts) as day, cast(0 as bigint) as min_id, count(*) - 1 as max_id, count(*) as n from events group by all")
def row_ids_dense(spark, sf_dir):
    rows = event_table(spark, sf_dir).table("events", with_ids=True)
    found = rows.groupBy("event_type", "day").agg(F.min("_row_id").alias("min_id"), F.max("_row_id").alias("max_id"), F.countDistinct("_segment_id", "_row_id").alias("n"))
    return found.select("event_type", zone_free(F.col("day")).alias("day"), "min_id", "max_id", "n")


@query("select count(*) as n, count(distinct 1) as distinct_times from events")
def written_at(spark, sf_dir):
    rows = event_table(spark, sf_dir).table("events", with_ids=True)
    return rows.agg(F.count("_written_at").alias("n"), F.countDistinct("_written_at").alias("distinct_times"))


@query("select value from events")
def read_segment_column(spark, sf_dir):
    """Of every segment: a large append fills several."""
    e = flat_table(spark, events(spark, sf_dir).select("event_id", "value"), {"event_id": "int64", "value": "float64"})
    return segment_columns(e, "t", "value")


def segment_columns(e: Engine, table: str, column: str) -> DataFrame:
    """A column of all segments, each read by a correlation of its own."""
    parts = [e.read_segment_column(table, s["partition"], s["segmentId"], column, f"read-{s['segmentId']}") for s in e.list_segments(table)]
    return reduce(DataFrame.unionByName, parts).select(column)


# deletes, compaction, snapshots


def _deleted(spark, sf_dir) -> Engine:
    def build(e):
        e.create_table("events", {"columns": EVENT_COLUMNS, "partitioning": {"event_type": "string"}})
        e.write("events", events(spark, sf_dir).drop("day"))
        e.delete_where("events", "event_id % 10 = 0")

    return built(spark, sf_dir, "deleted", build)


@query(f"{EVENTS_SQL} where event_id % 10 <> 0")
def delete_rows(spark, sf_dir):
    return as_events(_deleted(spark, sf_dir).table("events"))


@query("select count(*) filter (event_id % 7 = 0) as first_n, cast(0 as bigint) as second_n, count(*) filter (event_id % 7 <> 0) as left_n from events")
def delete_idempotent(spark, sf_dir):
    e = flat_table(spark, events(spark, sf_dir).select("event_id"), {"event_id": "int64"})
    n = [e.delete_where("t", "event_id % 7 = 0")["nDeleted"] for _ in range(2)]
    return spark.createDataFrame([(*n, e.row_count("t"))], "first_n long, second_n long, left_n long")


@query("select event_id from events where event_id not in (select event_id from events order by event_id limit 3)")
def delete_from_segment(spark, sf_dir):
    e = flat_table(spark, events(spark, sf_dir).select("event_id"), {"event_id": "int64"})
    first = e.table("t", with_ids=True).orderBy("event_id").limit(3).collect()
    for r in first:
        e.delete_from_segment("t", {}, r["_segment_id"], [r["_row_id"], r["_row_id"]])
    return e.table("t")


@query("select event_type, count(*) filter (event_id % 10 = 0) as n from events group by event_type having n > 0")
def read_deletions(spark, sf_dir):
    e = _deleted(spark, sf_dir)
    found = None
    for s in e.list_segments("events"):
        rows = e.read_segment_deletions("events", s["partition"], s["segmentId"], f"deletions-{uuid.uuid4()}")
        rows = rows.select(F.lit(s["partition"]["event_type"]).alias("event_type"))
        found = rows if found is None else found.unionByName(rows)
    return found.groupBy("event_type").agg(F.count("*").alias("n"))


@query(EVENTS_SQL)
def compact_preserves_rows(spark, sf_dir):
    e = Engine(spark, scratch(spark))
    e.create_table("events", {"columns": EVENT_COLUMNS, "partitioning": {"event_type": "string"}})
    rows = events(spark, sf_dir).drop("day")
    for part in (0, 1):
        e.write("events", rows.where(F.col("event_id") % 2 == part))
    e.compact("events", force=True)
    return as_events(e.table("events"))


@query(f"{EVENTS_SQL} where event_id % 3 <> 0 and event_id % 5 <> 0")
def compact_after_delete(spark, sf_dir):
    e = flat_table(spark, events(spark, sf_dir).drop("day"), EVENT_COLUMNS, {"event_type": "string"})
    e.delete_where("t", "event_id % 3 = 0")
    e.compact("t", force=True)
    e.delete_where("t", "event_id % 5 = 0")
    return as_events(e.table("t"))


@query("select count(*) filter (event_id % 3 <> 0) as n_rows, cast(1 as bigint) as n_files, cast(0 as bigint) as n_vectors from events")
def compact_removes_deleted(spark, sf_dir):
    """Compaction leaves one file a segment: n_files is the most that any segment has, as a large append fills several."""
    e = flat_table(spark, events(spark, sf_dir).select("event_id"), {"event_id": "int64"})
    e.delete_where("t", "event_id % 3 = 0")
    e.compact("t", force=True)
    e.vacuum("t", 0)
    segments = e.catalog.state("t").segments.values()
    counts = (sum(sum(s.files.values()) for s in segments), max(len(s.files) for s in segments), sum(len(s.deletes) for s in segments))
    return spark.createDataFrame([counts], "n_rows long, n_files long, n_vectors long")


@query("select event_id, value from events where event_id < (select count(*) // 2 from events)")
def snapshot_read(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", "value")
    half = rows.count() // 2
    e = flat_table(spark, rows.where(F.col("event_id") < half), {"event_id": "int64", "value": "float64"})
    pin = e.snapshot("t")
    e.write("t", rows.where(F.col("event_id") >= half))
    e.delete_where("t", "event_id % 2 = 0")
    e.compact("t", force=True)
    e.vacuum("t", 0)
    return pin.read()


@query("select event_id, value from events")
def read_your_writes(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", "value")
    e = flat_table(spark, rows.where("event_id % 2 = 0"), {"event_id": "int64", "value": "float64"})
    e.write("t", rows.where("event_id % 2 = 1"))
    return e.table("t")


# catalog


@query("select event_id, case when event_id >= 5000 then value end as value2 from events")
def alter_add_column(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", F.col("value").alias("value2"))
    e = flat_table(spark, rows.where("event_id < 5000").select("event_id"), {"event_id": "int64"})
    e.alter_table("t", {"value2": "float64"})
    e.write("t", rows.where("event_id >= 5000"))
    return e.table("t")


@query("select event_id, case when event_id >= 5000 then value end as value2 from events")
def create_add_columns(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", F.col("value").alias("value2"))
    e = flat_table(spark, rows.where("event_id < 5000").select("event_id"), {"event_id": "int64"})
    e.create_table("t", {"columns": {"event_id": "int64", "value2": "float64"}}, "addNewColumns")
    e.write("t", rows.where("event_id >= 5000"))
    return e.table("t")


@query(
    "select * from (values ('fail', 'InvalidRequest'), ('exact', 'exists'), ('other columns', 'InvalidRequest'), ('add', 'added b'), ('retyped', 'InvalidRequest'), ('other partitions', 'InvalidRequest')) t(attempt, outcome)"
)
def create_table_modes(spark, sf_dir):
    e = Engine(spark, scratch(spark))
    a, ab = {"a": "int64"}, {"a": "int64", "b": "string"}
    e.create_table("t", {"columns": a})
    tries = [
        ("fail", a, {}, "failIfExists"), ("exact", a, {}, "okIfExact"), ("other columns", ab, {}, "okIfExact"),
        ("add", ab, {}, "addNewColumns"), ("retyped", {"a": "string"}, {}, "addNewColumns"), ("other partitions", ab, {"p": "bool"}, "okIfExact"),
    ]
    out = []
    for name, columns, partitioning, mode in tries:
        try:
            done = e.create_table("t", {"columns": columns, "partitioning": partitioning}, mode)
            out.append((name, "added " + ",".join(done["columnsAdded"]) if done["columnsAdded"] else "exists"))
        except InvalidRequest:
            out.append((name, "InvalidRequest"))
    return spark.createDataFrame(out, "attempt string, outcome string")


@query(
    "select * from (values ('event_id', 'column', 'int64', 0), ('ts', 'column', 'timestampMicros', 0), ('user_id', 'column', 'int64', 0), ('value', 'column', 'float64', 0), ('props', 'column', 'string', 0), ('event_type', 'partition', 'string', 0), ('day', 'partition', 'timestampMinute', 0)) t(name, kind, dtype, nested_list_depth)"
)
def get_schema(spark, sf_dir):
    return event_table(spark, sf_dir).schema_frame("events")


@query("select * from (values ('alpha'), ('beta')) t(table_name)")
def list_tables(spark, sf_dir):
    e = Engine(spark, scratch(spark))
    for name in ("beta", "alpha", "gone"):
        e.create_table(name, {"columns": {"a": "int64"}})
    e.drop_table("gone")
    return spark.createDataFrame([(t["tableName"],) for t in e.list_tables()["tables"]], "table_name string")


@query("select event_id from events where event_id % 2 = 1")
def drop_recreate(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id")
    e = flat_table(spark, rows.where("event_id % 2 = 0"), {"event_id": "int64"})
    e.drop_table("t")
    try:
        e.table("t")
        raise AssertionError("a dropped table can be read")
    except NotFound:
        pass
    e.create_table("t", {"columns": {"event_id": "int64"}})
    e.write("t", rows.where("event_id % 2 = 1"))
    return e.table("t")


# accounting, rotation, types, validation


@query("select cast(sum(8 + 12 + 8 + 8 + (2 + strlen(props)) + 20) as bigint) as bytes from events")
def uncompressed_size(spark, sf_dir):
    e = event_table(spark, sf_dir)
    return spark.createDataFrame([(sum(s.uncompressed_bytes for s in e.catalog.state("events").segments.values()),)], "bytes long")


@query(
    "with b as (select count(*) as n, count(*) // 10 + 1 as size from events) "
    "select i as segment, least(4 * size, n - 4 * size * i) as row_count from b, range(3) r(i) where 4 * size * i < n"
)
def segment_rotation(spark, sf_dir):
    """Ten batches into segments of a bit over three: a segment takes whole batches, so it ends after the fourth."""
    rows = events(spark, sf_dir).select("event_id", "value")
    n = rows.count()
    size = n // 10 + 1
    e = Engine(spark, scratch(spark), default_segment_target_rows=3 * size + 1)
    e.create_table("t", {"columns": {"event_id": "int64", "value": "float64"}})
    for low in range(0, n, size):
        e.write("t", rows.where((F.col("event_id") >= low) & (F.col("event_id") < low + size)))
    segments = list(e.catalog.state("t").segments.values())
    return spark.createDataFrame([(i, s.row_count) for i, s in enumerate(segments)], "segment long, row_count long")


def _nested(spark, sf_dir, depth: int) -> DataFrame:
    vector = F.transform("embedding", lambda x: x.cast("double"))
    for _ in range(depth - 1):
        vector = F.array(vector)
    e = flat_table(spark, source(spark, sf_dir, "embeddings").select("vec_id", vector.alias("v")), {"vec_id": "int64", "v": {"dtype": "float64", "nestedListDepth": depth}})
    inner = F.col("v")
    for _ in range(depth - 1):
        inner = inner[0]
    micros = F.round(inner[3] * 1_000_000).cast("long")
    return e.table("t").select("vec_id", F.size(inner).cast("long").alias("n"), micros.alias("fourth"))


NESTED_SQL = "select vec_id, len(embedding) as n, cast(round(cast(embedding[4] as double) * 1000000) as bigint) as fourth from embeddings"


@query(NESTED_SQL)
def nested_list_d1(spark, sf_dir):
    return _nested(spark, sf_dir, 1)


@query(NESTED_SQL)
def nested_list_d2(spark, sf_dir):
    return _nested(spark, sf_dir, 2)


@query(NESTED_SQL)
def nested_list_d3(spark, sf_dir):
    return _nested(spark, sf_dir, 3)


@query(EVENTS_SQL)
def json_ingest(spark, sf_dir):
    rows = events(spark, sf_dir)
    text = F.to_json(F.struct("event_id", F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("ts"), "user_id", "value", "props"))
    e = Engine(spark, scratch(spark))
    e.create_table("t", {"columns": EVENT_COLUMNS, "partitioning": {"event_type": "string"}})
    e.write_json("t", rows.select(text.alias("value_json"), "event_type"), "value_json")
    return as_events(e.table("t"))


@query(f"select count(*) as n from documents where strlen(text) + 2 > {MAX_FIELD_BYTES}")
def validate_field_size(spark, sf_dir):
    return source(spark, sf_dir, "documents").where(value_bytes(F.col("text"), "string") > MAX_FIELD_BYTES).agg(F.count("*").alias("n"))


@query(r"select regexp_full_match(p_name, '[A-Za-z0-9_!*()\-]*') as allowed, count(*) as n from part group by all")
def validate_partition_string(spark, sf_dir):
    return source(spark, sf_dir, "part").groupBy(F.col("p_name").rlike(TEXT_SQL).alias("allowed")).agg(F.count("*").alias("n"))


@query("select count(*) as n from events where epoch_us(ts) % 60000000 = 0")
def validate_minute(spark, sf_dir):
    return events(spark, sf_dir).where(whole_minute(F.col("ts"))).agg(F.count("*").alias("n"))


@query("select count(*) filter (event_id % 3 = 0) as n from events")
def validate_list_nulls(spark, sf_dir):
    lists = F.array(F.col("event_id"), F.when(F.col("event_id") % 3 != 0, F.col("user_id")))
    return events(spark, sf_dir).where(holds_null(lists, 1)).agg(F.count("*").alias("n"))


@query("select make_timestamp(cast(floor(epoch(ts) / 432000) * 432000 as bigint) * 1000000) as bucket, count(*) as n from events group by all")
def time_bucket_5d(spark, sf_dir):
    return events(spark, sf_dir).groupBy(zone_free(time_bucket(F.col("ts"))).alias("bucket")).agg(F.count("*").alias("n"))


@query("select cast('0x' || substr(md5(cast(event_id as varchar)), 1, 4) as int) >> 13 as shard, count(*) as n from events group by all")
def shard_of_uuid(spark, sf_dir):
    return events(spark, sf_dir).groupBy(shard_column(F.md5(F.col("event_id").cast("string")), 3).alias("shard")).agg(F.count("*").alias("n"))


# streams


@query(EVENTS_SQL)
def stream_ingest(spark, sf_dir):
    def build(e):
        e.create_table("events", {"columns": EVENT_COLUMNS, "partitioning": {"event_type": "string"}})
        schema = source(spark, sf_dir, "events").schema
        stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(*_stream_folder(sf_dir))
        rows = stream.select("event_id", instant(F.col("ts")).alias("ts"), "user_id", "event_type", "value", "props")
        q = ingest(e, "events", rows, f"{scratch(spark)}/checkpoint", every=None, name="events")
        q.awaitTermination()
        e.create_table("metrics", {"columns": {"response_time": "float32", "concurrency": "int64", "errors": "int64", "write_start_at": "timestampMicros"}, "partitioning": {"action": "string"}})
        e.write_to_partition("metrics", {"action": "write"}, progress_rows(q))

    return as_events(built(spark, sf_dir, "stream", build).table("events"))


def _stream_folder(sf_dir: str) -> list[str]:
    return [f"{sf_dir}/events.parque[t]"]


@query("select 'write' as action, cast(1 as bigint) as n_batches, cast(0 as bigint) as errors, true as timed")
def perf_table_agg(spark, sf_dir):
    """One file is one batch; how long it took differs, that it was timed doesn't."""
    stream_ingest(spark, sf_dir)
    e = _built[(spark.sparkContext.applicationId, sf_dir, "stream")]
    timed = F.every((F.col("response_time") > 0) & (F.col("concurrency") == 1)).alias("timed")
    return e.table("metrics").groupBy("action").agg(F.count("*").alias("n_batches"), F.sum("errors").alias("errors"), timed)


@query("select count(*) as n, count(*) as n_metrics, cast(0 as bigint) as errors, true as within from nation")
def paced_publisher(spark, sf_dir):
    """Single-row writes of concurrent writers, and their metrics."""
    e = Engine(spark, scratch(spark))
    e.create_table("t", {"columns": {"n_name": "string"}, "partitioning": {"n_regionkey": "int64"}})
    e.create_table("metrics", METRICS)
    rows = [({"n_regionkey": r.n_regionkey}, [{"n_name": r.n_name}]) for r in source(spark, sf_dir, "nation").collect()]
    publish(e, "t", rows, 1000, 5, "metrics")
    within = F.every(F.col("concurrency").between(1, 5)).alias("within")
    return e.table("t").agg(F.count("*").alias("n")).join(e.table("metrics").agg(F.count("*").alias("n_metrics"), F.sum("errors").alias("errors"), within), how="full", on=F.lit(True))


@query("select count(*) as n, true as bounded, true as sparse, cast(1 as bigint) as n_buckets from events")
def generated_rows(spark, sf_dir):
    e = Engine(spark, scratch(spark))
    e.create_table("events", EVENTS)
    e.write("events", random_rows(spark, source(spark, sf_dir, "events").count(), "2024-03-05T10:00:00Z"))
    ok = F.coalesce(F.col("int_col").between(0, 100), F.lit(True)) & F.coalesce((F.col("float_col") >= 1) & (F.col("float_col") < 2), F.lit(True))
    ok &= F.coalesce(F.size("list_col") <= 2, F.lit(True)) & F.coalesce(F.octet_length("bytes_col") < 20, F.lit(True))
    share = F.count("int_col") / F.count("*")
    return e.table("events").agg(F.count("*").alias("n"), F.every(ok).alias("bounded"), share.between(0.4, 0.6).alias("sparse"), F.countDistinct("time_bucket").alias("n_buckets"))


# edges: what requests come to. Each row is an attempt and its outcome.


def outcomes(spark: SparkSession, tries: Iterable[tuple[str, Callable]]) -> DataFrame:
    out = []
    for attempt, act in tries:
        try:
            out.append((attempt, str(act())))
        except StrataError as e:
            out.append((attempt, type(e).__name__))
    return spark.createDataFrame(out, "attempt string, outcome string")


def outcomes_sql(**expected: str) -> str:
    """Values are SQL expressions."""
    return " union all ".join(f"select '{k}' as attempt, cast({v} as varchar) as outcome" for k, v in expected.items())


INVALID, MISSING = "'InvalidRequest'", "'NotFound'"


@query("select n_nationkey, n_name, n_regionkey from nation")
def staged_writes(spark, sf_dir):
    """Single-row writes without a job each; the read that follows sees them all."""
    e = Engine(spark, scratch(spark))
    e.create_table("t", {"columns": {"n_nationkey": "int64", "n_name": "string"}, "partitioning": {"n_regionkey": "int64"}})
    for r in source(spark, sf_dir, "nation").collect():
        e.write_to_partition("t", {"n_regionkey": r.n_regionkey}, [{"n_nationkey": r.n_nationkey, "n_name": r.n_name}], stage=True)
    rows = e.table("t")
    return rows.select(*(F.col(c).cast("int") if c != "n_name" else F.col(c) for c in rows.columns))


@query(outcomes_sql(staged="(select count(*) from nation)", again="0"))
def flush(spark, sf_dir):
    e = Engine(spark, scratch(spark))
    e.create_table("t", {"columns": {"n_name": "string"}})
    for r in source(spark, sf_dir, "nation").collect():
        e.write_to_partition("t", {}, [{"n_name": r.n_name}], stage=True)
    return outcomes(spark, [("staged", lambda: e.flush()), ("again", lambda: e.flush())])


@query("select n_nationkey, n_name from nation")
def journal_recovery(spark, sf_dir):
    """Staged rows of a process that died are committed by the next one, once."""
    root = scratch(spark)
    e = Engine(spark, root)
    e.create_table("t", {"columns": {"n_nationkey": "int64", "n_name": "string"}})
    for r in source(spark, sf_dir, "nation").collect():
        e.write_to_partition("t", {}, [{"n_nationkey": r.n_nationkey, "n_name": r.n_name}], stage=True)
    e.stage.held.pop("t").file.close()
    for _ in range(2):
        Engine(spark, root).recover()
    rows = Engine(spark, root).table("t")
    return rows.withColumn("n_nationkey", F.col("n_nationkey").cast("int"))


@query("select cast(r_regionkey as bigint) as p, cast(0 as bigint) as row_count from region")
def empty_write(spark, sf_dir):
    e = Engine(spark, scratch(spark))
    e.create_table("t", {"columns": {"a": "int64"}, "partitioning": {"p": "int64"}})
    for r in source(spark, sf_dir, "region").collect():
        for _ in range(2):
            e.write_to_partition("t", {"p": r.r_regionkey}, [])
    return e.segments_frame("t").select("p", "row_count")


@query(
    "select attempt, case when attempt in ('absent value', 'unpartitioned') then cast((select count(*) from events) as varchar) else 'InvalidRequest' end as outcome "
    "from (values ('absent value'), ('no value'), ('no value of an unknown field'), ('text for an integer'), ('time for text'), ('bool for an integer'), ('unpartitioned'), ('unknown comparison')) t(attempt)"
)
def filter_edges(spark, sf_dir):
    e = flat_table(spark, events(spark, sf_dir).select("event_id", "user_id", "event_type"), {"event_id": "int64"}, {"user_id": "int64", "event_type": "string"})
    flat = flat_table(spark, events(spark, sf_dir).select("event_id"), {"event_id": "int64"})
    count = lambda engine, *f: lambda: engine.table("t", [PartitionFilter(*f)]).count()
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return outcomes(
            spark,
            [
                ("absent value", count(e, "user_id", "", None, True)), ("no value", count(e, "user_id", "EqTo", None)), ("no value of an unknown field", count(e, "zzz", "EqTo", None)),
                ("text for an integer", count(e, "user_id", "EqTo", "1")), ("time for text", count(e, "event_type", "EqTo", utc(2024, 1, 1))), ("bool for an integer", count(e, "user_id", "EqTo", True)),
                ("unpartitioned", count(flat, "user_id", "EqTo", 1)), ("unknown comparison", count(e, "user_id", "Like", 1)),
            ],
        )


@query(
    "select attempt, case when attempt like 'ok %' then '1' else 'InvalidRequest' end as outcome from (values ('unknown column'), ('float for an integer'), ('text for an integer'), ('integer too large'), "
    "('list for a scalar'), ('scalar for a list'), ('null in a list'), ('time without zone'), ('no base64'), ('no rows'), ('no JSON'), ('no UTF-8'), ('missing partition field'), ('unknown partition field'), "
    "('partition of another type'), ('partition characters'), ('seconds in a minute'), ('field too large'), ('ok row'), ('ok largest field'), ('ok null')) t(attempt)"
)
def row_validation(spark, sf_dir):
    e = Engine(spark, scratch(spark))
    columns = {"i": "int64", "s": "string", "b": "bytes", "t": "timestampMicros", "l": {"dtype": "int64", "nestedListDepth": 1}}
    e.create_table("t", {"columns": columns, "partitioning": {"p": "string", "m": "timestampMinute"}})
    p = {"p": "a-b", "m": "2024-01-01T00:00:00Z"}
    write = lambda rows, own=None: lambda: e.write_to_partition("t", p if own is None else own, rows, stage=True)["rows"]
    return outcomes(
        spark,
        [
            ("unknown column", write([{"zzz": 1}])), ("float for an integer", write([{"i": 1.0}])), ("text for an integer", write([{"i": "1"}])), ("integer too large", write([{"i": 1 << 63}])),
            ("list for a scalar", write([{"i": [1]}])), ("scalar for a list", write([{"l": 1}])), ("null in a list", write([{"l": [1, None]}])), ("time without zone", write([{"t": "2024-01-01T00:00:00"}])),
            ("no base64", write([{"b": "a"}])), ("no rows", write({"i": 1})), ("no JSON", write("[{")), ("no UTF-8", write(b"\xff")), ("missing partition field", write([{"i": 1}], {"p": "a"})),
            ("unknown partition field", write([{"i": 1}], p | {"q": 1})), ("partition of another type", write([{"i": 1}], p | {"p": 1})), ("partition characters", write([{"i": 1}], p | {"p": "a/b"})),
            ("seconds in a minute", write([{"i": 1}], p | {"m": "2024-01-01T00:00:01Z"})), ("field too large", write([{"s": "x" * (MAX_FIELD_BYTES - 1)}])), ("ok row", write([{"i": 1, "l": [1, 2], "b": "YQ=="}])),
            ("ok largest field", write([{"s": "x" * (MAX_FIELD_BYTES - 2)}])), ("ok null", write([{"i": None}])),
        ],
    )


@query(
    "select attempt, case when attempt like 'ok %' then 'created' when attempt like 'missing %' then 'NotFound' else 'InvalidRequest' end as outcome from (values ('no name'), ('name with a dot'), ('name too long'), ('leading underscore'), "
    "('no schema'), ('unknown type'), ('list too deep'), ('partition type'), ('five partition fields'), ('column and partition'), ('256 columns'), ('ok 255 columns'), ('ok long name'), ('alter by nothing'), ('alter by a duplicate'), "
    "('missing table'), ('missing table altered'), ('missing table dropped')) t(attempt)"
)
def name_validation(spark, sf_dir):
    e = Engine(spark, scratch(spark))
    e.create_table("there", {"columns": {"a": "int64"}})
    wide = lambda n: {"columns": {f"c{i}": "bool" for i in range(n)}}
    create = lambda name, schema: lambda: e.create_table(name, schema) and "created"
    a = {"columns": {"a": "int64"}}
    return outcomes(
        spark,
        [
            ("no name", create("", a)), ("name with a dot", create("a.b", a)), ("name too long", create("x" * 256, a)), ("leading underscore", create("_x", a)), ("no schema", create("x", None)),
            ("unknown type", create("x", {"columns": {"a": "decimal"}})), ("list too deep", create("x", {"columns": {"a": {"dtype": "bool", "nestedListDepth": 4}}})), ("partition type", create("x", a | {"partitioning": {"p": "float64"}})),
            ("five partition fields", create("x", a | {"partitioning": {f"p{i}": "bool" for i in range(5)}})), ("column and partition", create("x", a | {"partitioning": {"a": "bool"}})), ("256 columns", create("x", wide(256))),
            ("ok 255 columns", create("wide", wide(255))), ("ok long name", create("x" * 200, a)), ("alter by nothing", lambda: e.alter_table("there", {})), ("alter by a duplicate", lambda: e.alter_table("there", {"a": "int64"})),
            ("missing table", lambda: e.table("zzz")), ("missing table altered", lambda: e.alter_table("zzz", {"a": "bool"})), ("missing table dropped", lambda: e.drop_table("zzz")),
        ],
    )


CLICKS = "(select count(*) from events where event_type = 'click')"


@query(outcomes_sql(column=CLICKS, deletions="0", again=CLICKS, other_segment=INVALID, no_correlation=INVALID, no_uuid=INVALID, other_partition=MISSING, unknown_column=MISSING))
def correlated_reads(spark, sf_dir):
    """A correlation is pinned to the first segment and version that it reads."""
    e = flat_table(spark, events(spark, sf_dir).select("event_id", "event_type"), {"event_id": "int64"}, {"event_type": "string"})
    of = {s["partition"]["event_type"]: s for s in e.list_segments("t")}
    click, other = of["click"], of["purchase"]
    read = lambda s, c="c", column="event_id", partition=None: e.read_segment_column("t", partition or s["partition"], s["segmentId"], column, c).count()

    def again() -> int:
        e.delete_where("t", "event_type = 'click'")
        e.compact("t", force=True)
        e.vacuum("t", 0)
        return read(click)

    return outcomes(
        spark,
        [
            ("column", lambda: read(click)), ("deletions", lambda: e.read_segment_deletions("t", click["partition"], click["segmentId"], "d").count()), ("again", again), ("other_segment", lambda: read(other)),
            ("no_correlation", lambda: read(click, "")), ("no_uuid", lambda: e.read_segment_column("t", click["partition"], "x", "event_id", "u").count()), ("other_partition", lambda: read(click, "p", partition=other["partition"])),
            ("unknown_column", lambda: read(click, "q", "zzz")),
        ],
    )


@query("select event_id, value from events")
def vacuum_retention(spark, sf_dir):
    """A reader that began before a compaction still has its files after the clean-up: they were replaced just now."""
    e = flat_table(spark, events(spark, sf_dir).select("event_id", "value"), {"event_id": "int64", "value": "float64"})
    reader = e.table("t")
    e.compact("t", force=True)
    e.maintain()
    return reader


@query("select event_id, value from events where event_id % 2 = 0")
def pinned_by_another(spark, sf_dir):
    """A snapshot of one process is kept by the clean-up of another."""
    rows, root = events(spark, sf_dir).select("event_id", "value"), scratch(spark)
    e = Engine(spark, root)
    e.create_table("t", {"columns": {"event_id": "int64", "value": "float64"}})
    e.write("t", rows.where("event_id % 2 = 0"))
    pin = e.snapshot("t")
    other = Engine(spark, root)
    other.write("t", rows.where("event_id % 2 = 1"))
    other.compact("t", force=True)
    other.vacuum("t", 0)
    return pin.read()


@query(
    "select attempt, outcome from (values ('few rows', 'False'), ('enough rows', 'True'), ('half as many again', 'False'), ('twice as many', 'True'), ('twice, but a minute ago', 'False'), ('some more, and idle', 'True'), ('no more, and idle', 'False')) t(attempt, outcome)"
)
def compaction_due(spark, sf_dir):
    of = lambda n, **k: lambda: due(Segment({}, "s", all_time_n=n, **k), Settings(), 1e6)
    return outcomes(
        spark,
        [
            ("few rows", of(29_999)), ("enough rows", of(30_000)), ("half as many again", of(45_000, compacted_n=30_000, written_at=1e6)), ("twice as many", of(60_000, compacted_n=30_000, written_at=1e6)),
            ("twice, but a minute ago", of(60_000, compacted_n=30_000, compacted_at=1e6 - 59)), ("some more, and idle", of(30_001, compacted_n=30_000, written_at=1e6 - 1_801)), ("no more, and idle", of(30_000, compacted_n=30_000)),
        ],
    )


REGIONS = "(select count(*) from region)"


@query(outcomes_sql(uncommitted_write=REGIONS, uncommitted_compaction=REGIONS, unfinished_drop="'t'", after_recovery=MISSING))
def recovery(spark, sf_dir):
    """Jobs that die before their commit leave nothing; a drop that was cut off is ended."""
    rows, root = source(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("a")), scratch(spark)
    e = Engine(spark, root)
    e.create_table("t", {"columns": {"a": "int64"}})
    e.write("t", rows)

    def dies(act: Callable) -> int:
        log = e.catalog.log("t")
        log.commit = lambda *_: (_ for _ in ()).throw(KeyboardInterrupt)
        try:
            act()
        except KeyboardInterrupt:
            pass
        del log.commit
        return Engine(spark, root).table("t").count()

    def drop() -> str:
        e.catalog.log("t").commit(e.catalog.state("t"), {"kind": "drop"})
        return ",".join(Engine(spark, root).recover())

    return outcomes(
        spark,
        [
            ("uncommitted_write", lambda: dies(lambda: e.write("t", rows))), ("uncommitted_compaction", lambda: dies(lambda: e.compact("t", force=True))), ("unfinished_drop", drop),
            ("after_recovery", lambda: Engine(spark, root).table("t")),
        ],
    )


@query("select cast(i as bigint) as shard, cast(1 as bigint) as n_segments, true as own, true as child, true as parent, true as chosen from range(8) t(i)")
def shard_helpers(spark, sf_dir):
    out = []
    for k in range(8):
        shard = Shard(3, k)
        segment = shard.new_segment_id()
        chosen = choose(f"p={k}", 3)
        out.append((k, 1, shard.contains(segment) and shard_of(segment, 3) == k, sum(c.contains(segment) for c in shard.children()) == 1, shard.parent().contains(segment), chosen.n_log == 3 and 0 <= chosen.number < 8))
    return spark.createDataFrame(out, "shard long, n_segments long, own boolean, child boolean, parent boolean, chosen boolean")


@query("select count(*) as n, cast(1 as bigint) as n_of_a_shard from events")
def active_segments(spark, sf_dir):
    """Each shard has one active segment, however many writes it takes."""
    e = Engine(spark, scratch(spark), n_shards_log=1)
    e.create_table("t", {"columns": {"event_id": "int64"}})
    rows = events(spark, sf_dir).select("event_id")
    for k in range(6):
        e.write("t", rows.where(F.col("event_id") % 6 == k), layout="as_is")
    of = [shard_of(s["segmentId"], 1) for s in e.list_segments("t")]
    return e.table("t").agg(F.count("*").alias("n"), F.lit(max(map(of.count, of))).cast("long").alias("n_of_a_shard"))


@query(
    "select attempt, outcome from (values ('create', '200 alreadyExists,columnsAdded'), ('create again', '400 message'), ('create exact', '200 alreadyExists,columnsAdded'), ('write', '200 '), ('bad write', '400 message'), ('list', '200 tables'), ('empty body', '400 message'), "
    "('no UTF-8', '400 message'), ('read column', '200 rows'), ('read deletions', '200 rowIds'), ('unknown route', '404 message'), ('unknown table', '404 message'), ('drop', '200 ')) t(attempt, outcome)"
)
def http_answers(spark, sf_dir):
    e = Engine(spark, scratch(spark))

    def call(method: str, route: str, body) -> Callable:
        def act() -> str:
            status, found = answer(e, method, f"/rest/{route}", body if isinstance(body, bytes) else json.dumps(body).encode())
            return f"{status} {','.join(sorted(found))}"

        return act

    t = {"tableName": "t"}
    create = t | {"schema": {"columns": {"a": {"dtype": "int64"}}}}
    segment = lambda: t | {"segmentId": e.list_segments("t")[0]["segmentId"], "correlationId": str(uuid.uuid4())}
    return outcomes(
        spark,
        [
            ("create", call("POST", "create_table", create)), ("create again", call("POST", "create_table", create)), ("create exact", call("POST", "create_table", create | {"mode": "okIfExact"})),
            ("write", call("POST", "write_to_partition", t | {"rows": [{"a": 1}]})), ("bad write", call("POST", "write_to_partition", t | {"rows": [{"b": 1}]})), ("list", call("GET", "list_tables", {})),
            ("empty body", call("GET", "list_tables", b"")), ("no UTF-8", call("GET", "list_tables", b"\xff")), ("read column", lambda: call("GET", "read_segment_column", segment() | {"columnName": "a"})()),
            ("read deletions", lambda: call("GET", "read_segment_deletions", segment())()), ("unknown route", call("POST", "zzz", {})), ("unknown table", call("POST", "drop_table", {"tableName": "zzz"})), ("drop", call("POST", "drop_table", t)),
        ],
    )


@query("select attempt, outcome from (values ('InvalidRequest', '400 shown'), ('NotFound', '404 shown'), ('TooManyRequests', '429 shown'), ('Corrupt', '500 hidden'), ('CommitConflict', '500 hidden')) t(attempt, outcome)")
def error_answers(spark, sf_dir):
    kinds = (InvalidRequest, NotFound, TooManyRequests, Corrupt, CommitConflict)
    return outcomes(spark, [(k.__name__, lambda k=k: f"{k.status} {'shown' if k('text').body()['message'] == 'text' else 'hidden'}") for k in kinds])


@query("select attempt, outcome from (values ('default', '3841 5000000'), ('flag', '1 7'), ('unknown option', 'InvalidRequest')) t(attempt, outcome)")
def config_options(spark, sf_dir):
    show = lambda o: f"{o['port']} {o['default_segment_target_rows']}"
    return outcomes(
        spark,
        [
            ("default", lambda: show(options([], {}))), ("flag", lambda: show(options(["--port", "1", "--default-segment-target-rows", "7"], {}))),
            ("unknown option", lambda: Engine(spark, scratch(spark), nonsense=1)),
        ],
    )


TYPES_SQL = (
    "select l_orderkey, cast(l_linenumber as bigint) as l_linenumber, l_quantity > 25 as large, cast(l_discount as float) as discount, epoch_us(l_shipdate) as shipped, hex(encode(l_returnflag)) as flag, [l_returnflag, l_linestatus] as flags from lineitem"
)


@query(TYPES_SQL)
def type_roundtrip(spark, sf_dir):
    """Each scalar type, and a list, through a compaction."""
    rows = source(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), (F.col("l_quantity") > 25).alias("large"), F.col("l_discount").cast("float").alias("discount"),
        instant(F.col("l_shipdate")).alias("shipped"), F.encode("l_returnflag", "UTF-8").alias("flag"), F.array("l_returnflag", "l_linestatus").alias("flags"),
    )
    kinds = {"l_orderkey": "int64", "l_linenumber": "int64", "large": "bool", "discount": "float32", "shipped": "timestampMicros", "flag": "bytes", "flags": {"dtype": "string", "nestedListDepth": 1}}
    e = flat_table(spark, rows, kinds)
    e.compact("t", force=True)
    return e.table("t").withColumns({"shipped": F.unix_micros("shipped"), "flag": F.hex("flag")})


@query("with b as (select cast(sum(8 + 20) as bigint) as size from events) select true as split, count(*) as n, cast(0 as bigint) as min_id from events, b group by all")
def large_append(spark, sf_dir):
    """An append that fills several segments is dealt to several, each with ids from 0."""
    rows = events(spark, sf_dir).select("event_id").repartition(8)
    e = Engine(spark, scratch(spark), default_segment_target_rows=max(1, rows.count() // 5))
    e.create_table("t", {"columns": {"event_id": "int64"}})
    e.write("t", rows, layout="as_is")
    found = e.table("t", with_ids=True).groupBy("_segment_id").agg(F.count("*").alias("n"), F.min("_row_id").alias("low"))
    return found.agg((F.count("*") > 2).alias("split"), F.sum("n").alias("n"), F.max("low").alias("min_id"))


# Spark SQL over the tables


def _orders(spark, sf_dir) -> Engine:
    def build(e):
        e.create_table("orders", {"columns": {"o_orderkey": "int64", "o_custkey": "int64", "o_totalprice": "float64"}, "partitioning": {"o_orderstatus": "string"}})
        e.write("orders", source(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"))
        e.create_table("lineitem", {"columns": {"l_orderkey": "int64", "l_linenumber": "int64", "l_quantity": "float64", "l_extendedprice": "float64"}, "partitioning": {"l_returnflag": "string"}})
        e.write("lineitem", source(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag"))

    e = built(spark, sf_dir, "orders", build)
    e.view("orders", "strata_orders")
    e.view("lineitem", "strata_lineitem")
    return e


JOIN_SQL = "select o.o_orderstatus, l.l_returnflag, count(*) as n, cast(sum(cast(round(l.l_extendedprice * 100) as bigint)) as bigint) as cents from {o} o join {l} l on o.o_orderkey = l.l_orderkey group by o.o_orderstatus, l.l_returnflag"
AGG_SQL = "select l_returnflag, count(*) as n, count(distinct l_orderkey) as n_orders, cast(sum(cast(l_quantity as bigint)) as bigint) as quantity from {l} group by l_returnflag"
WINDOW_SQL = "select l_orderkey, l_linenumber, r from (select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by l_linenumber desc) as r from {l}) where r <= 2"


@query(JOIN_SQL.format(o="orders", l="lineitem"))
def join_over_tables(spark, sf_dir):
    _orders(spark, sf_dir)
    return spark.sql(JOIN_SQL.format(o="strata_orders", l="strata_lineitem"))


@query(AGG_SQL.format(l="lineitem"))
def agg_over_tables(spark, sf_dir):
    _orders(spark, sf_dir)
    return spark.sql(AGG_SQL.format(l="strata_lineitem"))


@query("select cast(l_orderkey as bigint) as l_orderkey, cast(l_linenumber as bigint) as l_linenumber, r from (" + WINDOW_SQL.format(l="lineitem") + ")")
def window_over_tables(spark, sf_dir):
    rows = _orders(spark, sf_dir).table("lineitem")
    r = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_linenumber")))
    return rows.select("l_orderkey", "l_linenumber", r.cast("long").alias("r")).where("r <= 2")
