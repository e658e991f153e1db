"""Row-level deletes: row ids are added to delete vectors, and scans leave them out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.errors import CommitConflict, InvalidRequest, NotFound
from strata.operators.catalog import Catalog
from strata.sources.scan import DELETE_SCHEMA, deletes

RETRIES = 20


class Deleter:
    def __init__(self, spark: SparkSession, catalog: Catalog):
        self.spark, self.catalog, self.store = spark, catalog, catalog.store

    def delete_ids(self, table: str, segment_id: str, row_ids: list[int]) -> int:
        """From one segment; returns how many weren't deleted before."""
        if not row_ids:
            raise InvalidRequest("no row ids")
        state = self.catalog.state(table)
        segment = state.segments.get(segment_id)
        if segment is None:
            raise NotFound(f"segment {segment_id}")
        if any(isinstance(i, bool) or not isinstance(i, int) or i < 0 for i in row_ids) or max(row_ids) >= segment.all_time_n:
            raise InvalidRequest(f"row ids must be below {segment.all_time_n}, the segment's rows")
        rows = self.spark.createDataFrame([(segment_id, i) for i in set(row_ids)], DELETE_SCHEMA)
        return self.delete_rows(table, rows, [segment_id])

    def delete_rows(self, table: str, rows: DataFrame, touched: list[str] | None = None) -> int:
        """Deletes ``rows(_segment_id, _row_id)``, of any number; those deleted already, or unknown, aren't counted.

        The request is written down first: a commit that comes between reads it again, not what it was computed from,
        and only the segments that it names are looked at.
        """
        asked = f"_tmp/{uuid.uuid4().hex}"
        try:
            rows.select("_segment_id", F.col("_row_id").cast("long").alias("_row_id")).distinct().write.parquet(self.store.uri(asked))
            rows = self.spark.read.schema(DELETE_SCHEMA).parquet(self.store.uri(asked))
            if touched is None:
                touched = [r[0] for r in rows.select("_segment_id").distinct().collect()]  # segments, which the log has on the driver too
            return self._delete(table, rows, set(touched))
        finally:
            self.store.delete(asked)

    def _delete(self, table: str, rows: DataFrame, touched: set[str]) -> int:
        for _ in range(RETRIES):
            state = self.catalog.state(table)
            segments = [state.segments[i] for i in touched if i in state.segments]
            new = rows.join(deletes(self.spark, self.store, table, segments), ["_segment_id", "_row_id"], "left_anti")
            # rows that compaction has removed aren't in files any more, so they can't be deleted again
            if any(s.omitted_n for s in segments):
                from strata.sources.scan import _files

                there = _files(self.spark, self.store, table, state, [s for s in segments if s.omitted_n], True).select("_segment_id", "_row_id")
                whole = [s.segment_id for s in segments if not s.omitted_n]
                new = new.where(F.col("_segment_id").isin(whole)).unionByName(new.join(there, ["_segment_id", "_row_id"], "left_semi"))
            path = f"{uuid.uuid4().hex}.parquet"
            uri = self.store.uri(f"{table}/deletes/{path}")
            new.write.option("compression", "zstd").parquet(uri)
            counts = {r._segment_id: r.n for r in self.spark.read.schema(DELETE_SCHEMA).parquet(uri).groupBy("_segment_id").agg(F.count("*").alias("n")).collect()}
            counts = {k: v for k, v in counts.items() if k in state.segments}
            n = sum(counts.values())
            try:
                self.catalog.log(table).commit(state, {"kind": "delete", "path": path, "n": n, "segments": counts})
                return n
            except CommitConflict:
                self.store.delete(f"{table}/deletes/{path}")
        raise CommitConflict(f"table {table}")
