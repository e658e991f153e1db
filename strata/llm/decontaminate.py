"""Benchmark decontamination: a prefix-filtered containment join over item-sized windows.

A benchmark item's windows are its runs of ``width`` words, or the whole item where it has fewer. A
document holds a window only if it holds all the window's shingles, so the join needs one prefix token
a window, and its rarest shingle by document frequency over all documents is taken. A document position
of that shingle at offset o of the window gives one candidate start; the positional bound (start >= 0)
and the length bound (start + length <= document length) cut it before its words are compared exactly.

The index of prefix tokens is broadcast only while the benchmark's texts stay under ``broadcast_bytes``
(measured first); larger benchmarks are joined by a shuffle on the tokens' hashes, with equal results.

Null or wordless texts have no words and no hits. Items that share an item_id are one item; windows of
items without id mark words but count for no item. Repeated document rows are each reported.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from strata.llm.common import alnum_words, raw_texts, remembered, staged

WIDTH, SHINGLE, MIN_ITEMS = 8, 3, 2
#: Benchmark texts up to this size are indexed in each worker's memory, some 400 times their words' count in bytes.
BROADCAST_BYTES = 1 << 20

#: A large benchmark's bitmap has this many bits for each of its shingles, and two to these powers at least and at most.
SPARSE, LEAST_BITS, MOST_BITS = 16, 10, 27

RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def windows(words: list, width: int) -> list[tuple]:
    if not words:
        return []
    return list(dict.fromkeys(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))))


def shingles(words, k: int = SHINGLE) -> list[tuple]:
    k = min(k, len(words))
    return [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]


class Index:
    """Prefix tokens of all windows of a benchmark, by shingle length."""

    def __init__(self, items: list[tuple[str | None, bytes]], frequency: dict[tuple, int], width: int):
        by_window: dict[tuple, set] = defaultdict(set)
        for item, raw in items:
            for window in windows(alnum_words(raw), width):
                by_window[window].add(item)
        self.tokens: dict[int, dict[tuple, list]] = defaultdict(lambda: defaultdict(list))
        for window, names in by_window.items():
            own = shingles(window)
            offset = min(range(len(own)), key=lambda i: (frequency.get(own[i], 0), i))
            self.tokens[len(own[offset])][own[offset]].append((offset, window, frozenset(names - {None})))
        self.sets = {k: frozenset(t) for k, t in self.tokens.items()}

    def find(self, words: list[bytes]):
        """(start, end, item ids) of every occurrence of a window."""
        for k, tokens in self.sets.items():
            found = tokens.intersection(zip(*(words[i:] for i in range(k)), strict=False))
            if found:
                for at, gram in enumerate(zip(*(words[i:] for i in range(k)), strict=False)):
                    if gram in found:
                        for offset, window, names in self.tokens[k][gram]:
                            start = at - offset
                            if start >= 0 and start + len(window) <= len(words) and tuple(words[start : start + len(window)]) == window:
                                yield start, start + len(window), names


def items_digest(items) -> str:
    return sha256(",".join(sorted(items)).encode()).hexdigest()


def _items(benchmark: DataFrame) -> list[tuple[str | None, bytes]]:
    """Only called once the benchmark's size is known to be under the bound."""
    return [(r.item_id, (r.text or "").encode()) for r in benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").collect()]


def small(benchmark: DataFrame, limit: int) -> bool:
    size = benchmark.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    return (size[0] or 0) + 16 * size[1] <= limit


def frequencies(docs: DataFrame, items: list[tuple[str | None, bytes]], width: int) -> dict[tuple, int]:
    """Documents that hold each shingle of the benchmark, over all documents; as many entries as it has shingles."""
    own = {s for _, raw in items for w in windows(alnum_words(raw), width) for s in shingles(w)}
    names = sorted(own)
    by_length: dict[int, dict[tuple, int]] = defaultdict(dict)
    for i, s in enumerate(names):
        by_length[len(s)][s] = i
    sets = {k: frozenset(v) for k, v in by_length.items()}

    def run(batches):
        remembered("decontaminate")
        counts: Counter = Counter()
        for batch in batches:
            for raw in raw_texts(batch.column(0)):
                words = alnum_words(raw)
                for k, known in sets.items():
                    counts.update(known.intersection(zip(*(words[i:] for i in range(k)), strict=False)))
        ids = [by_length[len(s)][s] for s in counts]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["i", "n"])

    rows = docs.select("text").mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()
    return {names[r.i]: r.n for r in rows}


def _measure(index: Index, words: list[bytes]) -> tuple[int, set]:
    hit, items = np.zeros(len(words), bool), set()
    for start, end, names in index.find(words):
        hit[start:end] = True
        items |= names
    return int(hit.sum()), items


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, min_items: int = MIN_ITEMS, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """A row for each row of ``docs(doc_id, text)``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    docs = docs.select("doc_id", "text")
    if not small(benchmark, broadcast_bytes):
        return _by_shuffle(docs, benchmark, width, min_items).drop("h")
    index = _broadcast_index(docs, benchmark, width)

    def run(batches):
        for batch in batches:
            rows = []
            for raw in raw_texts(batch.column(1)):
                words = alnum_words(raw)
                n_hit, items = _measure(index.value, words)
                rows.append((len(words), n_hit, len(items), items_digest(items), len(items) >= min_items))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    return docs.mapInArrow(run, f"{docs.schema['doc_id'].name} {docs.schema['doc_id'].dataType.simpleString()}, {RESULT}")


def _broadcast_index(docs: DataFrame, benchmark: DataFrame, width: int):
    items = _items(benchmark)
    plain = Index(items, frequencies(docs, items, width), width)
    plain.tokens = {k: dict(t) for k, t in plain.tokens.items()}
    return docs.sparkSession.sparkContext.broadcast(plain)


def keep_clean(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, min_items: int = MIN_ITEMS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` without its contaminated rows, all columns kept; each row is judged by its own text."""
    if not small(benchmark, broadcast_bytes):
        found = _by_shuffle(docs.select("doc_id", "text"), benchmark, width, min_items).where("contaminated")
        found = found.select(F.col("doc_id").alias("_strata_d"), F.col("h").alias("_strata_h")).distinct()
        on = F.col("doc_id").eqNullSafe(F.col("_strata_d")) & (F.xxhash64("text") == F.col("_strata_h"))
        return docs.join(found.hint("shuffle_hash"), on, "left_anti")
    index = _broadcast_index(docs, benchmark, width)
    at = docs.columns.index("text")

    def run(batches):
        remembered("decontaminate")
        for batch in batches:
            keep = [len(_measure(index.value, alnum_words(raw))[1]) < min_items for raw in raw_texts(batch.column(at))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _token(gram: tuple) -> int:
    return xxh64_intdigest(b" ".join(gram), len(gram)) - (1 << 63)


def _by_shuffle(docs: DataFrame, benchmark: DataFrame, width: int, min_items: int) -> DataFrame:
    """The same rows, and h, the hash of each one's text, by a join on the prefix tokens' hashes.

    A bitmap of the benchmark's hashes, sized by their number and of 16 MB at most, keeps most document positions out
    of the shuffle; those that pass are written once, with the words around them for the exact comparison. Beyond some
    eight million shingles it lets more pass, which costs shuffle but changes nothing. A prefix token that very many
    documents hold is a skewed key of a plain join, which adaptive execution splits.
    """
    spark = docs.sparkSession

    def item_tokens(batches):
        for batch in batches:
            rows = []
            for item, raw in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), strict=True):
                for w in windows(alnum_words(raw), width):
                    words = [x.decode() for x in w]
                    rows += [{"item_id": item, "window": words, "offset": i, "k": len(g), "token": _token(g)} for i, g in enumerate(shingles(w))]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema({"item_id": pa.string(), "window": pa.list_(pa.string()), "offset": pa.int32(), "k": pa.int32(), "token": pa.int64()}))

    tokens = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(
        item_tokens, "item_id string, window array<string>, offset int, k int, token long"
    ).distinct()
    tokens = staged(spark, tokens, "prefix-tokens")
    lengths = sorted(row[0] for row in tokens.select("k").distinct().collect())  # SHINGLE of them at most
    n = tokens.select("token").distinct().count()
    bits = min(MOST_BITS, max(LEAST_BITS, (SPARSE * n).bit_length()))
    place = F.shiftrightunsigned("token", 64 - bits)
    marks = tokens.select(F.shiftrightunsigned(place, 6).cast("int").alias("word"), place.alias("place"))
    marks = marks.groupBy("word").agg(F.expr("bit_or(shiftleft(1L, cast(place & 63 as int)))").alias("mask")).toPandas()
    bitmap = np.zeros(1 << (bits - 6), np.int64)
    bitmap[marks["word"].to_numpy(np.int64)] = marks["mask"].to_numpy(np.int64)
    bitmap = spark.sparkContext.broadcast(bitmap.view(np.uint64))

    def places(batches):
        known = bitmap.value
        for batch in batches:
            rows = []
            for doc, h, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw_texts(batch.column(2)), strict=True):
                words = alnum_words(raw)
                for k in lengths:
                    grams = zip(*(words[i:] for i in range(k)), strict=False)
                    hashes = np.fromiter(map(_token, grams), np.int64)
                    at = hashes.view(np.uint64) >> np.uint64(64 - bits)
                    for at in np.flatnonzero(known[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).tolist():
                        low = max(0, at - width + 1)
                        rows.append((doc, h, len(words), at, int(hashes[at]), low, [x.decode() for x in words[low : at + width + SHINGLE]]))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            types = [batch.schema.field(0).type, pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "h", "n", "at", "token", "low", "near"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    places = staged(spark, keyed.mapInArrow(places, f"doc_id {id_type}, h long, n int, at int, token long, low int, near array<string>"), "places")
    counts = (
        places.select("doc_id", "h", "token").join(tokens.select("token").distinct(), "token", "left_semi")
        .distinct().groupBy("token").agg(F.count("*").alias("n_docs"))
    )
    prefix = (
        tokens.join(counts, "token", "left").groupBy("item_id", "window")
        .agg(F.min_by(F.struct("offset", "token"), F.struct(F.coalesce("n_docs", F.lit(0)), "offset")).alias("p"))
        .select("item_id", "window", "p.offset", "p.token")
    )
    start = F.col("at") - F.col("offset")
    hits = (
        places.join(prefix, "token")
        .where((start >= 0) & (start + F.size("window") <= F.col("n")))
        .where(F.slice("near", start - F.col("low") + 1, F.size("window")) == F.col("window"))
        .select("doc_id", "h", "item_id", F.explode(F.sequence(start, start + F.size("window") - 1)).alias("word"))
    )
    words_hit = hits.select("doc_id", "h", "word").distinct().groupBy("doc_id", "h").agg(F.count("*").alias("n_hit"))
    items_hit = (
        hits.where("item_id is not null").select("doc_id", "h", "item_id").distinct()
        .groupBy("doc_id", "h").agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    )

    def sizes(batches):
        for batch in batches:
            n = [len(alnum_words(raw)) for raw in raw_texts(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["doc_id", "h", "n_words"])

    found = keyed.mapInArrow(sizes, f"doc_id {id_type}, h long, n_words long")
    for side in (words_hit, items_hit):
        side = side.withColumnsRenamed({"doc_id": "d", "h": "g"})
        found = found.join(side, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("h").eqNullSafe(F.col("g")), "left").drop("d", "g")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return found.select(
        "doc_id", "h", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.size(items) >= min_items).alias("contaminated"),
    )
