"""Stupid-backoff scores by joins of n-gram counts.

Texts are packed into blocks of some ``BLOCK`` words. A block's n-grams of each order are exploded, hashed
to 64 bits and made distinct with their counts; these are dealt to buckets by their hashes' leading bits. The count
tables, partitioned in the same way, have the totals of each bucket's n-grams that occur in several blocks (the counts of
others are those of their block), and are joined to the exploded n-grams bucket by bucket; both sides come from one
exchange, which Spark reuses. The blocks' answers meet their words again by block, and every document's terms are summed.

A word is scored by the longest n-gram that ends with it and occurs outside its own document:
``count(n-gram) / count(context)``, times ``ALPHA`` for each order given up. Counts leave out the document's
own occurrences, or every n-gram of a scored text would be known. A word seen nowhere else counts half.

An n-gram sends one entry a block however often it occurs, so frequent ones make no task larger, and a bucket's
size follows from the number of buckets, which grows with the input without a limit. A block sends a row to each
bucket that it has n-grams for: as the buckets grow in number these rows shrink, to single n-grams in the end, so
there are never more rows than distinct n-grams in blocks. Packed rows hold sorted hashes as byte planes of their
differences; nothing goes through the driver but the corpus's number of words.

This is the join of exploded n-grams with hash-partitioned count tables, done on packed columns and not on rows of
Spark: a row for each n-gram of each block takes three times the room in a shuffle.

Words are the lower-cased alphanumeric ones; texts without any (null, empty) have a log-probability of 0.
``docs`` is read twice, for the n-grams and for the words, and must be a deterministic read, which the last step
checks: blocks are known by their content, so it doesn't matter where they are made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import alnum_words, raw_texts, staged
from strata.llm.hashing import run_hashes, word_hashes

ORDER, ALPHA = 3, 0.4
#: Words in a block, and n-grams in a bucket, about.
BLOCK, BUCKET = 2_000_000, 2_000_000
ROW = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("k", pa.int32()), ("ids", pa.list_(pa.int64())), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
ROW_SQL = "bucket int, block long, k int, ids array<long>, a binary, b binary, c binary"
CODEC = pa.Codec("zstd", compression_level=1)


def planes(x: np.ndarray) -> bytes:
    """The array's bytes plane by plane, each compressed by its own statistics, or as it is where that is shorter:
    leading bytes are mostly alike, trailing ones of hashes are random."""
    parts = [len(x).to_bytes(8, "little")]
    for plane in np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T):
        raw = plane.tobytes()
        packed = CODEC.compress(raw, asbytes=True)
        packed = packed if len(packed) < len(raw) else raw
        parts += [len(packed).to_bytes(4, "little"), packed]
    return b"".join(parts)


def unplanes(packed: bytes, dtype: str) -> np.ndarray:
    kind, n, at = np.dtype(dtype), int.from_bytes(packed[:8], "little"), 8
    out = np.empty((n, kind.itemsize), np.uint8)
    for i in range(kind.itemsize):
        size = int.from_bytes(packed[at : at + 4], "little")
        own = packed[at + 4 : at + 4 + size]
        out[:, i] = np.frombuffer(own if size == n else CODEC.decompress(own, n, asbytes=True), np.uint8)
        at += 4 + size
    return out.view(kind).ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    return planes(np.diff(x, prepend=np.zeros(1, x.dtype)))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unplanes(raw, "<u8"), dtype=np.uint64)


def grams(h: np.ndarray, lengths: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of order k inside documents, and the positions of their last words."""
    hashes = run_hashes(h, k)
    begin = np.repeat(np.cumsum(lengths) - lengths, lengths)
    at = np.flatnonzero(np.arange(len(h)) - begin >= k - 1)
    return hashes[at - k + 1], at


class Block:
    def __init__(self):
        self.ids: list = []
        self.lengths: list[int] = []
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id, h: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.lengths.append(len(h))
        self.parts.append(h)
        self.size += len(h)

    def name(self, h: np.ndarray) -> int:
        """The same wherever and whenever the block is made; blocks of equal content share it, and their answers."""
        digest = xxhash.xxh64(h.tobytes())
        digest.update(repr((self.ids, self.lengths)).encode())
        return digest.intdigest() - (1 << 63)

    def rows(self, buckets: int, order: int, words: bool):
        """With ``words`` the row of the block's words (k = 0), else those of its distinct n-grams by bucket."""
        h, lengths = np.concatenate([*self.parts, np.zeros(0, np.uint64)]), np.array(self.lengths, np.int64)
        number = self.name(h)
        if words:
            vocabulary, inverse, n = np.unique(h, return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")  # frequent words get small numbers, which pack best
            rank = np.empty(len(order), "<u4")
            rank[order] = np.arange(len(order))
            yield 0, number, 0, self.ids, planes(lengths.astype("<u8")), planes(vocabulary[order]), planes(rank[inverse])
            return
        for k in range(1, order + 1):
            distinct, n = np.unique(grams(h, lengths, k)[0], return_counts=True)
            of = (distinct >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)  # by leading bits, so in order
            edges = np.flatnonzero(np.diff(of, prepend=np.uint64(buckets), append=np.uint64(buckets)))
            for low, high in zip(edges, edges[1:], strict=False):
                yield int(of[low]), number, k, None, pack_sorted(distinct[low:high]), planes(n[low:high].astype("<u4")), None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ROW, strict=True)], schema=ROW)


def _explode(docs: DataFrame, buckets: int, order: int, block_words: int, words: bool) -> DataFrame:
    def run(batches):
        block = Block()
        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), strict=True):
                block.add(doc_id, word_hashes(alnum_words(raw)))
                if block.size >= block_words:
                    for row in block.rows(buckets, order, words):
                        yield _batch([row])
                    block = Block()
        if block.ids:
            for row in block.rows(buckets, order, words):
                yield _batch([row])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ROW_SQL)


TABLE = pa.schema([("bucket", pa.int32()), ("k", pa.int32()), ("hashes", pa.binary()), ("totals", pa.binary())])
TABLE_SQL = "bucket int, k int, hashes binary, totals binary"


def _count(t: pa.Table) -> pa.Table:
    """A bucket's part of the count tables: of each order the n-grams of several blocks, sorted, and their totals."""
    rows, out = t.to_pylist(), []
    for k in sorted({r["k"] for r in rows}):
        own = [r for r in rows if r["k"] == k]
        distinct, inverse, blocks = np.unique(np.concatenate([unpack_sorted(r["a"]) for r in own]), return_inverse=True, return_counts=True)
        total = np.bincount(inverse, np.concatenate([unplanes(r["b"], "<u4") for r in own])).astype("<u8")
        out.append((own[0]["bucket"], k, pack_sorted(distinct[blocks > 1]), planes(total[blocks > 1])))
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), TABLE, strict=True)], schema=TABLE)


def _join(asked: pa.Table, tables: pa.Table) -> pa.Table:
    """A bucket: the blocks' n-grams get how often they occur outside their block, from its count tables."""
    known = {r["k"]: (unpack_sorted(r["hashes"]), unplanes(r["totals"], "<u8")) for r in tables.to_pylist()}
    out = []
    for batch in asked.to_batches(max_chunksize=64):
        for r in batch.to_pylist():
            hashes, totals = known[r["k"]]
            own, n = unpack_sorted(r["a"]), unplanes(r["b"], "<u4")
            at = np.searchsorted(hashes, own)
            at[at == len(hashes)] = 0
            found = np.flatnonzero(hashes[at] == own) if len(hashes) else []
            outside = np.zeros(len(own), "<u8")
            outside[found] = totals[at[found]] - n[found]
            out.append((r["bucket"], r["block"], r["k"], None, planes(outside), None, None))
    return pa.Table.from_batches([_batch(out)]) if out else ROW.empty_table()


def _score(t: pa.Table, order: int, alpha: float) -> pa.Table:
    """A block (or several of equal content): its words again, and every n-gram's count outside it; each document's sums."""
    rows = t.to_pylist()
    answers: dict[int, dict[int, bytes]] = {k: {} for k in range(1, order + 1)}
    for r in rows:
        if r["k"]:
            answers[r["k"]][r["bucket"]] = r["a"]
    totals = {k: np.concatenate([*(unplanes(a[b], "<u8") for b in sorted(a)), np.zeros(0, "<u8")]) for k, a in answers.items()}
    return pa.concat_tables([_score_block(r, dict(totals), order, alpha) for r in rows if r["k"] == 0])


def _score_block(own: dict, totals: dict[int, np.ndarray], order: int, alpha: float) -> pa.Table:
    lengths = unplanes(own["a"], "<u8").astype(np.int64)
    h = unplanes(own["b"], "<u8")[unplanes(own["c"], "<u4")]
    doc = np.repeat(np.arange(len(lengths)), lengths)
    n = len(h)
    log, level = np.zeros(n), np.zeros(n, np.int8)
    below = np.zeros(n)  # outside counts of the order below, by the position of its last word
    for k in range(1, order + 1):
        hashes, at = grams(h, lengths, k)
        distinct, inverse, here = np.unique(hashes, return_inverse=True, return_counts=True)
        if len(totals[k]) != len(distinct):
            raise RuntimeError("the documents were read differently the second time; score() needs a deterministic read")
        outside = np.zeros(n)
        outside[at] = (totals.pop(k) + here.astype("<u8"))[inverse]
        pair = doc[at] * max(1, len(distinct)) + inverse
        del hashes, distinct, inverse, here  # a block's arrays are a worker's largest
        _, back, mine = np.unique(pair, return_inverse=True, return_counts=True)
        outside[at] -= mine[back]
        del pair, back, mine
        if k == 1:
            log = np.log(np.maximum(outside, 0.5))
            level[:] = 1
        else:
            known = np.flatnonzero(outside > 0)
            log[known] = np.log(outside[known]) - np.log(below[known - 1])
            level[known] = k
        below = outside
    log += (order - level) * np.log(alpha)
    sums = [np.bincount(doc, x, len(lengths)) for x in (log, level == 1, level == order)]
    return pa.table(
        {
            "doc_id": pa.array(own["ids"], pa.int64()), "n_words": pa.array(lengths), "log_terms": pa.array(sums[0]),
            "n_unigrams": pa.array(sums[1].astype(np.int64)), "n_full": pa.array(sums[2].astype(np.int64)),
        }
    )


def count_tables(exploded: DataFrame) -> DataFrame:
    """The n-gram count tables, partitioned by hash: a row for each bucket and order."""
    return exploded.groupBy("bucket").applyInArrow(_count, TABLE_SQL)


def score(spark: SparkSession, docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, block_words: int = BLOCK, bucket_grams: int = BUCKET) -> DataFrame:
    """A row for each row of ``docs(doc_id, text)``: doc_id, n_words, log_prob, log_prob_per_word,
    and how many words were scored by a full n-gram (n_full) and by their own frequency alone (n_unigrams)."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, size // 6 * order // bucket_grams + 1)
    exploded = _explode(docs, buckets, order, block_words, False)
    tables = count_tables(exploded)
    answered = exploded.groupBy("bucket").cogroup(tables.groupBy("bucket")).applyInArrow(_join, ROW_SQL)  # both by one exchange
    rows = _explode(docs, buckets, order, block_words, True).unionByName(answered)
    summed = rows.groupBy("block").applyInArrow(
        lambda t: _score(t, order, alpha), "doc_id long, n_words long, log_terms double, n_unigrams long, n_full long"
    )
    summed = staged(spark, summed, "lm-sums")
    words = summed.agg(F.sum("n_words")).first()[0] or 0
    others = F.greatest(F.lit(words) - F.col("n_words"), F.lit(1)).cast("double")
    log_prob = F.col("log_terms") - F.col("n_unigrams") * F.log(others)
    return summed.select(
        "doc_id", "n_words", log_prob.alias("log_prob"),
        F.when(F.col("n_words") > 0, log_prob / F.col("n_words")).otherwise(0.0).alias("log_prob_per_word"), "n_full", "n_unigrams",
    )
