"""A workload generator: random sparse rows, and paced concurrent writers that record their own metrics."""

from __future__ import annotations

import datetime as dt
import threading
import time
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.engine import Engine
from strata.errors import StrataError
from strata.functions.time import time_bucket

EVENTS = {
    "columns": {
        "bool_col": "bool", "bytes_col": "bytes", "float_col": "float64", "int_col": "int64",
        "list_col": {"dtype": "string", "nestedListDepth": 1}, "timestamp_col": "timestampMicros",
    },
    "partitioning": {"time_bucket": "timestampMinute"},
}
METRICS = {
    "columns": {"response_time": "float32", "concurrency": "int64", "errors": "int64", "write_start_at": "timestampMicros"},
    "partitioning": {"action": "string"},
}
WORDS = ("amber", "basalt", "chalk", "dolomite", "gneiss", "loam", "marl", "shale")


def random_rows(spark: SparkSession, n: int, now: str, seed: int = 0, present: float = 0.5) -> DataFrame:
    """n rows of EVENTS; each column is there with probability ``present``."""
    draw = iter(range(seed * 100, seed * 100 + 100))
    r = lambda: F.rand(next(draw))
    maybe = lambda c: F.when(r() < present, c)
    word = lambda: F.element_at(F.array(*map(F.lit, WORDS)), (F.floor(r() * len(WORDS)) + 1).cast("int"))
    at = F.lit(now).cast("timestamp")
    return spark.range(n).select(
        maybe(r() < 0.001).alias("bool_col"),
        maybe(F.to_binary(F.repeat(F.lpad(F.hex(F.floor(r() * 256)), 2, "0"), F.floor(r() * 20).cast("int")), F.lit("hex"))).alias("bytes_col"),
        maybe(1 + r()).alias("float_col"),
        maybe(F.floor(r() * 101)).alias("int_col"),
        maybe(F.slice(F.array(word(), word()), 1, F.floor(r() * 3).cast("int"))).alias("list_col"),
        maybe(at).alias("timestamp_col"),
        time_bucket(at).alias("time_bucket"),
    )


def delay_seconds(rows_per_second: float, max_concurrency: int) -> float:
    """The pause between single-row writes of each of up to ``max_concurrency`` writers."""
    return (max_concurrency + 1) / (2 * rows_per_second)


def publish(engine: Engine, table: str, requests: Iterable[tuple[dict, list]], rows_per_second: float, max_concurrency: int = 5, metrics: str | None = None) -> dict:
    """Writes each (partition, rows) by one of ``max_concurrency`` threads, each pausing in between; staged writes.

    With ``metrics``, a row for each write goes to that table (of METRICS), in partition ``write``.
    """
    left, lock = iter(requests), threading.Lock()
    pause, busy, done = delay_seconds(rows_per_second, max_concurrency), [0], {"writes": 0, "errors": 0}

    def work() -> None:
        while True:
            with lock:
                request = next(left, None)
                if request is None:
                    return
                busy[0] += 1
                concurrency = busy[0]
            began, errors = dt.datetime.now(dt.UTC), 0
            try:
                engine.write_to_partition(table, *request, stage=True)
            except StrataError:
                errors = 1
            took = (dt.datetime.now(dt.UTC) - began).total_seconds()
            with lock:
                busy[0] -= 1
                done["writes"] += 1
                done["errors"] += errors
            if metrics:
                row = {"response_time": took, "concurrency": concurrency, "errors": errors, "write_start_at": began.isoformat(timespec="microseconds")}
                engine.write_to_partition(metrics, {"action": "write"}, [row], stage=True)
            time.sleep(pause)

    threads = [threading.Thread(target=work) for _ in range(max_concurrency)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    return done
