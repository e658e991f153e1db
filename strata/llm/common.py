"""What several corpus operators share: words, shared folders, Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: ASCII letters lower-cased, digits and every byte of a non-ASCII character kept,
#: all else a separator: the words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of a lower-cased text.
ALNUM = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)


def alnum_words(raw: bytes) -> list[bytes]:
    return raw.translate(ALNUM).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where that is unset and all runs in one JVM, as in tests, a temporary folder is made and set.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None)
    if not root:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not sc._jsc.sc().isLocal():
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="strata-checkpoint-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(root)
    return root


def shared_path(spark: SparkSession, what: str) -> str:
    """A fresh place in the shared folder."""
    return f"{shared_root(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def staged(spark: SparkSession, df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends there. It goes when the driver's JVM does."""
    path = shared_path(spark, what)
    df.write.parquet(path)
    drop_at_exit(spark, path)
    table = spark.read.schema(df.schema).parquet(path)
    table.staged_path = path
    return table


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """Has the driver's JVM delete an existing path when it ends."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)


def unstage(spark: SparkSession, table: DataFrame) -> None:
    """Deletes what ``staged`` wrote, once nothing reads it any more."""
    drop_path(spark, table.staged_path)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_remembered: dict[str, dict] = {}


def remembered(owner: str) -> dict:
    """What an operator keeps in this worker process from task to task; what others have kept is dropped,
    so a worker that runs one stage after another holds the memory of one operator at a time."""
    if owner not in _remembered:
        for own in _remembered.values():
            own.clear()
        _remembered.clear()
        _remembered[owner] = {}
    return _remembered[owner]


def raw_texts(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of a string column without decoding it; null is empty."""
    column = column.cast(pa.binary()) if not pa.types.is_binary(column.type) else column
    for x in column:
        yield x.as_py() or b""


def arrow_map(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]], schema: str
) -> DataFrame:
    """``mapInArrow`` with state made once a task; ``make()`` returns the function for a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            yield from each(batch)

    return df.mapInArrow(run, schema)
