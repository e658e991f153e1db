"""SimHash near-duplicates: BK-trees over fingerprint shards.

Fingerprints within ``radius`` bits agree on at least ``blocks - radius`` of ``blocks`` bit blocks,
so every link lies in a shard of fingerprints that share such blocks. Distinct fingerprints go to
their shards; each shard's rows build BK-trees (children keyed by the integer Hamming distance to
their parent) and search them, following only edges within the radius of the distance. A shard over
``shard_cap`` fingerprints is cut into sub-shards, and each sub-shard's tree is sent to the queries of
every other: no task holds more than two sub-shards, and every pair of them still meets once. The
more fingerprints, the more blocks, so that shards stay small; no case is dropped at any size.

A shard reports a star for each of its groups of linked fingerprints, never all pairs: one edge a member.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import raw_texts, remembered, staged
from strata.llm.components import components

SHINGLE, RADIUS, SEED = 3, 3, 42
#: Fingerprints in a sub-shard; (query, node) pairs looked at in one step of a search.
SHARD_CAP, STEP = 40_000, 1 << 21
#: Hashes whose bits are counted at once.
HASHES = 1 << 15


def fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    """Of a UTF-8 text: bit i is set if it is set in over half the shingles' hashes; no words: 0."""
    words = raw.lower().split()  # bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for low in range(0, n, HASHES):
        high = min(n, low + HASHES)
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[low:high], ends[low:high], strict=True)], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, h, fp)``: the text's hash, and the 64 bits as a signed long. Null is empty."""

    def run(batches):
        remembered("simhash")
        for batch in batches:
            fps = np.fromiter(map(fingerprint, raw_texts(batch.column(2))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], names=["doc_id", "h", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    return rows.mapInArrow(run, "doc_id long, h long, fp long")


class Forest:
    """BK-trees, one for each group of distinct fingerprints, built and searched level by level."""

    def __init__(self, fps: np.ndarray, group: np.ndarray):
        """group: non-decreasing."""
        n = len(fps)
        self.fps = fps
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if n else np.zeros(0, np.int64)
        self.roots = first
        self.root_of = dict(zip(group[first].tolist(), first.tolist(), strict=True))
        at = np.repeat(first, np.diff(np.append(first, n)))
        rest = np.setdiff1d(np.arange(n), first, assume_unique=True)
        parents, edges, nodes = [], [], []
        while len(rest):
            parent = at[rest]
            edge = np.bitwise_count(fps[rest] ^ fps[parent]).astype(np.int64)
            key = parent * 65 + edge
            order = np.argsort(key, kind="stable")
            rest, key = rest[order], key[order]
            new = np.concatenate(([True], key[1:] != key[:-1]))
            child = rest[new]
            nodes.append(child)
            parents.append(key[new])
            at[rest] = child[np.cumsum(new) - 1]
            rest = rest[~new]
        key = np.concatenate([np.zeros(0, np.int64), *parents])
        order = np.argsort(key, kind="stable")
        self.keys, self.children = key[order], np.concatenate([np.zeros(0, np.int64), *nodes])[order]

    def search(self, fps: np.ndarray, root: np.ndarray, radius: int):
        """Yields arrays (query, node) with a distance within the radius; query i begins at node root[i]."""
        query, node = np.arange(len(fps)), root
        while len(query):
            d = np.bitwise_count(fps[query] ^ self.fps[node]).astype(np.int64)
            near = d <= radius
            if near.any():
                yield query[near], node[near]
            low = np.searchsorted(self.keys, node * 65 + np.maximum(d - radius, 0))
            high = np.searchsorted(self.keys, node * 65 + np.minimum(d + radius, 64), "right")
            n = high - low
            query = np.repeat(query, n)
            node = self.children[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unites a[i] and b[i] in ``label``, which points at the smallest member found."""
    while len(a):
        a, b = label[a], label[b]
        differ = a != b
        a, b = a[differ], b[differ]
        if not len(a):
            return
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def link(fps: np.ndarray, group: np.ndarray, asks: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges of groups of rows (non-decreasing ``group``).

    A group's rows with ``asks`` 0 make its tree and search it too; those with 1 search only.
    """
    tree = np.flatnonzero(asks == 0)
    forest = Forest(fps[tree], group[tree])
    label = np.arange(len(fps))
    both = np.unique(group[asks == 1])
    queries = np.flatnonzero((asks == 1) | ~np.isin(group, both))  # with guests, a tree's own pairs meet elsewhere
    size = np.bincount(group, minlength=int(group.max()) + 1 if len(group) else 0)
    queries = queries[np.array([int(g) in forest.root_of for g in group[queries]], bool)] if len(both) else queries
    root = np.array([forest.root_of[int(g)] for g in group[queries]], np.int64)
    cost = np.cumsum(size[group[queries]])
    cuts = np.unique(np.concatenate(([0], np.searchsorted(cost, np.arange(STEP, int(cost[-1]) + STEP, STEP)) + 1))) if len(queries) else [0]
    for low, high in zip(cuts, [*cuts[1:], len(queries)], strict=True):
        own = queries[low:high]
        for q, node in forest.search(fps[own], root[low:high], radius):
            merge(label, own[q], tree[node])
    member = np.flatnonzero(label != np.arange(len(fps)))
    return fps[member], fps[label[member]]


def blocks_for(n: int, radius: int) -> int:
    """Bit blocks for n fingerprints: shards of a few thousand at most, if fingerprints are spread evenly."""
    blocks = radius + 1
    while n >> (64 * (blocks - radius) // blocks) > 4096 and blocks < radius + 3:
        blocks += 1
    return blocks


def shard_keys(column: str, blocks: int, radius: int) -> F.Column:
    """An array of shard keys: for each choice of blocks, its number and their bits."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for k, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << cuts[i + 1]) - (1 << cuts[i])) for i in chosen)
        mask = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(k).cast("int").alias("k"), F.col(column).bitwiseAND(F.lit(mask)).alias("bits")))
    return F.array(*keys)


def links(spark: SparkSession, distinct: DataFrame, radius: int = RADIUS, shard_cap: int = SHARD_CAP) -> DataFrame:
    """``distinct(fp)`` to star edges ``(a, b)`` whose components are those of all links within the radius."""
    blocks = blocks_for(distinct.count(), radius)
    rows = distinct.select("fp", F.explode(shard_keys("fp", blocks, radius)).alias("s")).select("fp", "s.k", "s.bits")
    large = (
        rows.groupBy("k", "bits").agg(F.count("*").alias("n")).where(F.col("n") > shard_cap)
        .select("k", "bits", F.ceil(F.col("n") / shard_cap).cast("int").alias("parts"))
    )
    sized = rows.join(large, ["k", "bits"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = sized.withColumn("i", mine).withColumn("j", other).select(
        "fp", "k", "bits", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"),
        (F.col("i") > F.col("j")).cast("int").alias("asks"),
    )
    key = ["k", "bits", "i", "j"]
    return (
        dealt.repartition(*key).sortWithinPartitions(*key)
        .mapInArrow(lambda batches: _link_sorted(batches, radius), "a long, b long")
    )


def _link_sorted(batches, radius: int):
    """Whole groups of the sorted rows at a time; a group that goes on in the next batch waits for it."""
    held: list[pa.RecordBatch] = []

    def flush(t: pa.Table):
        keys = [t.column(c).to_numpy() for c in ("k", "bits", "i", "j")]
        new = np.concatenate(([False], np.any([k[1:] != k[:-1] for k in keys], axis=0)))
        a, b = link(t.column("fp").to_numpy().view(np.uint64), np.cumsum(new), t.column("asks").to_numpy(), radius)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        t = pa.Table.from_batches(held).combine_chunks()
        last = np.ones(t.num_rows, bool)
        for c in ("k", "bits", "i", "j"):
            values = t.column(c).to_numpy()
            last &= values == values[-1]
        cut = int(np.argmax(last))
        if cut:
            yield flush(t.slice(0, cut))
            held = t.slice(cut).to_batches()
    if held:
        yield flush(pa.Table.from_batches(held).combine_chunks())


def near_duplicates(spark: SparkSession, docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, h, fp, component_id)``, a row for each row; h is the text's hash.

    Texts without words have fingerprint 0 and link like any other. Equal fingerprints are one
    vertex, so a group of copies costs one row from the first grouping on. ``component_id`` is the
    smallest doc_id of the component; null ids take part but are never smallest.
    """
    rows = staged(spark, fingerprints(docs), "fingerprints")
    distinct = staged(spark, rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(spark, links(spark, distinct.select("fp"), radius))
    rooted = distinct.join(roots, distinct.fp == roots.vertex, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(rooted.join(smallest, "root").select("fp", "component_id"), "fp").select("doc_id", "h", "fp", "component_id")


def keep_one(spark: SparkSession, docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one document of each component: that of the smallest doc_id.

    Rows that repeat it, or give its id another text of the component, count as one too. Rows
    without id stay only where their whole component has none.
    """
    found = staged(spark, near_duplicates(spark, docs, radius), "components")
    first = found.where("doc_id = component_id").groupBy("doc_id", "component_id")
    several = first.agg(F.count("*").alias("n"), F.min("h").alias("first_h")).where("n > 1")
    several = staged(spark, several.select(F.col("component_id").alias("c"), "first_h"), "several")
    of_first = found.where("doc_id = component_id").join(several, F.col("component_id") == F.col("c")).where("h <> first_h")
    dropped = found.where("component_id is not null and not (doc_id <=> component_id)").select("doc_id", "h")
    dropped = dropped.unionByName(of_first.select("doc_id", "h")).distinct()
    dropped = staged(spark, dropped.select(F.col("doc_id").alias("_strata_d"), F.col("h").alias("_strata_h")), "dropped")
    on = F.col("doc_id").eqNullSafe(F.col("_strata_d")) & F.xxhash64("text").eqNullSafe(F.col("_strata_h"))
    kept = docs.join(dropped.hint("shuffle_hash"), on, "left_anti")  # the texts move once, unsorted, whatever the number dropped
    repeated = several.select(F.col("c").alias("_strata_c"))
    if repeated.limit(1).count():
        own = kept.join(repeated, F.col("doc_id") == F.col("_strata_c"), "left_semi").dropDuplicates(["doc_id"])
        kept = kept.join(repeated, F.col("doc_id") == F.col("_strata_c"), "left_anti").unionByName(own)
    return kept
