"""Approximate nearest neighbours by shifted space-filling curves.

Each of ``curves`` random orthogonal projections, shifted by a random offset, orders the vectors along a
Hilbert curve. A curve's key range is cut into buckets of some ``BUCKET`` vectors; a query is sent to its own
bucket and to the neighbouring ones inside its window, and the candidates of all curves merge and are ranked
again by their exact distances. There are as many buckets as the sample can tell apart; beyond that a bucket is dealt
to parts of some ``BUCKET`` vectors each by a hash, and its queries go to all of them, so no task's share of the index
grows with the input.

Everything fitted comes from at most ``sample_rows`` vectors, taken by a hash: ranges, bucket bounds, and the
window's width, the least at which the sample's own queries find ``target`` of their nearest vectors. Every vector is
indexed. Vectors without much structure need wide windows, and the work then nears that of a full scan; the
recall holds either way.

Equal vectors are one entry with the smallest ``k + 1`` ids: no more of them can be in any result, and a
vector that a third of all rows share costs one place. Their queries are answered together.

Null, zero and non-finite vectors, and those of another length than most, take no part.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.llm.common import staged

CURVES, DIMENSIONS, BITS = 8, 8, 8
BUCKET, SAMPLE_ROWS, TARGET, K = 1024, 16_384, 0.95, 10
MOST_BUCKETS = SAMPLE_ROWS // 4
SALTS = 32


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along a Hilbert curve of cells with ``bits`` bits a dimension; dimensions * bits <= 64.

    Axes are turned to the curve's transposed index by exchanging and inverting their lower bits from
    the highest bit down, then Gray-decoded; the index's bits are the axes' bits interleaved.
    """
    one = np.uint64(1)
    axes = [cells[:, i].astype(np.uint64) for i in range(cells.shape[1])]
    for level in range(bits - 1, 0, -1):
        bit, lower = one << np.uint64(level), (one << np.uint64(level)) - one
        for i, axis in enumerate(axes):
            on = (axis & bit) != 0
            swap = np.where(on, 0, (axes[0] ^ axis) & lower)
            flipped = np.where(on, axes[0] ^ lower, axes[0] ^ swap)
            axes[i] = axis ^ swap
            axes[0] = flipped if i else np.where(on, axis ^ lower, axis)
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    turn = np.zeros(len(cells), np.uint64)
    for level in range(bits - 1, 0, -1):
        turn = np.where((axes[-1] >> np.uint64(level)) & one != 0, turn ^ ((one << np.uint64(level)) - one), turn)
    key = np.zeros(len(cells), np.uint64)
    for level in range(bits - 1, -1, -1):
        for axis in axes:
            key = key << one | ((axis ^ turn) >> np.uint64(level)) & one
    return key


@dataclass
class Curves:
    projections: list[np.ndarray]
    low: list[np.ndarray]
    width: list[np.ndarray]
    shift: list[np.ndarray]
    bounds: list[np.ndarray]  # keys between buckets
    reach: int = 0  # buckets on either side of a query's own
    parts: int = 1  # of each bucket

    def keys(self, x: np.ndarray, c: int) -> np.ndarray:
        cells = ((x @ self.projections[c] - self.low[c]) / self.width[c] + self.shift[c]) * (1 << BITS)
        return hilbert_keys(np.clip(cells, 0, (1 << BITS) - 1), BITS)

    def bucket(self, x: np.ndarray, c: int) -> np.ndarray:
        return np.searchsorted(self.bounds[c], self.keys(x, c), "right")


def fit(sample: np.ndarray, n: int, curves: int = CURVES, target: float = TARGET, bucket: int = BUCKET, k: int = K, seed: int = 7) -> Curves:
    """Curves for n vectors, from a sample of them."""
    random = np.random.default_rng(seed)
    size = sample.shape[1] if sample.ndim == 2 else 1
    dimensions = min(DIMENSIONS, size)
    out = Curves([], [], [], [], [])
    buckets = int(min(MOST_BUCKETS, max(1, -(-n // bucket))))
    out.parts = max(1, -(-n // (bucket * buckets)))
    ranks = []
    for c in range(curves):
        out.projections.append(np.linalg.qr(random.standard_normal((size, dimensions)))[0])
        y = sample @ out.projections[c]
        low, high = (y.min(axis=0), y.max(axis=0)) if len(y) else (np.zeros(dimensions), np.ones(dimensions))
        width = np.where(high > low, high - low, 1.0) * 1.5
        out.low.append(low)
        out.width.append(width)
        out.shift.append(random.random(dimensions) / 3)
        keys = out.keys(sample, c) if len(sample) else np.zeros(0, np.uint64)
        out.bounds.append(np.sort(keys)[np.arange(1, buckets) * len(keys) // buckets] if buckets > 1 else np.zeros(0, np.uint64))
        rank = np.empty(len(keys))
        rank[np.argsort(keys, kind="stable")] = np.arange(len(keys)) / max(1, len(keys))
        ranks.append(rank)
    if buckets > 1:
        queries = np.arange(0, len(sample), max(1, len(sample) // 256))
        squares = (sample**2).sum(axis=1)
        away = squares[None, :] - 2 * sample[queries] @ sample.T
        away[np.arange(len(queries)), queries] = np.inf
        near = np.argpartition(away, k, axis=1)[:, :k]
        apart = np.min([np.abs(r[near] - r[queries][:, None]) for r in ranks], axis=0)
        out.reach = int(np.ceil(np.quantile(apart, target) * buckets))
    return out


def _prepare(rows: DataFrame, size: int, k: int, query_every: int) -> DataFrame:
    """Valid vectors, a row for each distinct one of a batch: key, vec, its k + 1 smallest ids, its queries' ids."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f8")
            x = flat.reshape(-1, size) + 0.0  # no negative zeros
            good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            order = np.flatnonzero(good)[np.argsort(ids[good], kind="stable")]
            held: dict[bytes, tuple[list, list]] = {}
            for i in order.tolist():
                own = held.setdefault(x[i].tobytes(), ([], []))
                if len(own[0]) <= k and (not own[0] or own[0][-1] != ids[i]):
                    own[0].append(int(ids[i]))
                if ids[i] % query_every == 0:
                    own[1].append(int(ids[i]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([blake2b(v, digest_size=16).digest() for v in held], pa.binary()), pa.array(list(held), pa.binary()),
                    pa.array([a for a, _ in held.values()], pa.list_(pa.int64())), pa.array([b for _, b in held.values()], pa.list_(pa.int64())),
                ],
                names=["key", "vec", "ids", "asks"],
            )

    return rows.mapInArrow(run, "key binary, vec binary, ids array<long>, asks array<long>")


def _smallest(rows: DataFrame, by: list[str], n: int) -> DataFrame:
    return rows.groupBy(*by).agg(F.first("vec").alias("vec"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, n).alias("ids"))


def _matrix(column, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), "<f8").reshape(-1, size)


def _deal(index: DataFrame, curves, size: int, queries: bool) -> DataFrame:
    """Rows by curve, bucket and part: entries to their own, queries to all in their window."""

    def run(batches):
        own = curves.value
        for batch in batches:
            x = _matrix(batch.column(1), size)
            part = np.array([int.from_bytes(k[:8], "little") % own.parts for k in batch.column(0).to_pylist()], np.int32)
            for c in range(len(own.projections)):
                bucket = own.bucket(x, c)
                if not queries:
                    yield _dealt(batch, c, bucket, part, np.arange(len(x)), 0)
                    continue
                low, high = np.maximum(bucket - own.reach, 0), np.minimum(bucket + own.reach, len(own.bounds[c])) + 1
                for step in range(2 * own.reach + 1):
                    to = low + step
                    sent = np.flatnonzero(to < high)
                    for p in range(own.parts) if len(sent) else ():
                        yield _dealt(batch, c, to[sent], np.full(len(sent), p, np.int32), sent, 1)

    return index.mapInArrow(run, "curve int, bucket int, part int, asks int, key binary, vec binary, ids array<long>")


def _dealt(batch: pa.RecordBatch, curve: int, bucket: np.ndarray, part: np.ndarray, rows: np.ndarray, asks: int) -> pa.RecordBatch:
    n, take = len(rows), pa.array(rows)
    ids = batch.column(2).take(take) if not asks else pa.nulls(n, pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, curve, np.int32)), pa.array(bucket.astype(np.int32)), pa.array(part), pa.array(np.full(n, asks, np.int32)), batch.column(0).take(take), batch.column(1).take(take), ids],
        names=["curve", "bucket", "part", "asks", "key", "vec", "ids"],
    )


def _search_sorted(batches, size: int, k: int):
    """Rows sorted by curve, bucket, part and asks: a part's entries are held while its queries stream past."""
    held, parts, ids = None, [], []
    x = squares = None
    for batch in batches:
        groups = np.stack([batch.column(i).to_numpy() for i in range(4)], axis=1)
        edges = np.flatnonzero(np.any(groups[1:] != groups[:-1], axis=1)) + 1
        for low, high in zip([0, *edges], [*edges, len(groups)], strict=True):
            if high == low:
                continue
            group, asks = tuple(groups[low][:3]), groups[low][3]
            if group != held:
                held, parts, ids, x = group, [], [], None
            part = batch.slice(low, high - low)
            if not asks:
                parts.append(_matrix(part.column(5), size))
                ids += part.column(6).to_pylist()
                continue
            if not parts:
                continue
            if x is None:
                x = np.concatenate(parts)
                squares = (x**2).sum(axis=1)
            q = _matrix(part.column(5), size)
            keys = part.column(4).to_pylist()
            step = max(1, (1 << 22) // len(x))
            for start in range(0, len(q), step):
                yield _nearest(keys[start : start + step], q[start : start + step], x, squares, ids, k)


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, squares added dimension by dimension: the same wherever they are taken."""
    return np.sqrt(np.add.accumulate((x - q) ** 2, axis=1)[:, -1])


def _nearest(keys: list, q: np.ndarray, x: np.ndarray, squares: np.ndarray, ids: list, k: int) -> pa.RecordBatch:
    about = squares[None, :] - 2 * q @ x.T + (q**2).sum(axis=1)[:, None]
    n = min(k + 1, len(x))
    limit = np.partition(about, n - 1, axis=1)[:, n - 1] if n else np.zeros(len(q))
    slack = 1e-9 * (1 + squares.max(initial=0) + (q**2).sum(axis=1))
    asked, score, found = [], [], []
    for i, key in enumerate(keys):
        near = np.flatnonzero(about[i] <= limit[i] + slack[i])
        exact = distances(x[near], q[i])
        for j, d in zip(near.tolist(), exact.tolist(), strict=True):
            asked.append(key)
            score.append(d)
            found.append(ids[j])
    return pa.RecordBatch.from_arrays([pa.array(asked, pa.binary()), pa.array(score, pa.float64()), pa.array(found, pa.list_(pa.int64()))], names=["key", "score", "ids"])


def nearest(
    spark: SparkSession, vectors: DataFrame, k: int = K, query_every: int = 100, curves: int = CURVES, target: float = TARGET,
    sample_rows: int = SAMPLE_ROWS, bucket: int = BUCKET,
) -> DataFrame:
    """The k nearest others of each row of ``vectors(vec_id, embedding)`` whose id is divisible by ``query_every``.

    query_id, rank (from 1), vec_id, score: Euclidean distance in double precision, ties to the smaller id.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null and embedding is not null")
    sizes = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    size = max(1, sizes[0].n) if sizes else 1
    rows = rows.where((F.size("embedding") == size) & F.forall("embedding", lambda v: v.isNotNull()))
    base = staged(spark, _prepare(rows, size, k, query_every), "vectors")
    salted = _smallest(base.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(SALTS))), ["key", "salt"], k + 1)
    index = staged(spark, _smallest(salted, ["key"], k + 1), "index")
    asks = base.select("key", F.explode("asks").alias("query_id")).distinct()
    n, scale = index.count(), 1 << 30
    sample = index.where(F.pmod(F.xxhash64("key"), F.lit(scale)) < (scale if n <= sample_rows else sample_rows * scale // n)).select("vec").toPandas()
    fitted = fit(np.frombuffer(b"".join(bytes(v) for v in sample["vec"]), "<f8").reshape(-1, size), n, curves, target, bucket, k)
    shared = spark.sparkContext.broadcast(fitted)
    asking = index.join(asks.select("key").distinct(), "key", "left_semi").select("key", "vec", "ids")
    entries = index.select("key", "vec", "ids")
    dealt = _deal(entries, shared, size, False).unionByName(_deal(asking, shared, size, True))
    found = dealt.repartition("curve", "bucket", "part").sortWithinPartitions("curve", "bucket", "part", "asks").mapInArrow(
        lambda batches: _search_sorted(batches, size, k), "key binary, score double, ids array<long>"
    )
    pairs = found.select("key", "score", F.explode("ids").alias("vec_id")).distinct()
    by_score = Window.partitionBy("key").orderBy("score", "vec_id")
    pairs = pairs.withColumn("r", F.row_number().over(by_score)).where(F.col("r") <= k + 1)
    lists = pairs.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("all"))
    own = lists.join(asks, "key").select("query_id", F.slice(F.filter("all", lambda c: c["vec_id"] != F.col("query_id")), 1, k).alias("all"))
    return own.select("query_id", F.posexplode("all").alias("at", "c")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("c.vec_id").alias("vec_id"), F.col("c.score").alias("score")
    )
