"""Repeated passages by sparse suffix arrays.

Only suffixes at content-selected positions are kept: of every window of ``min_words`` words the
leftmost least hash of ``K`` words (its minimiser). Equal windows select equal positions, so two
occurrences of a passage of ``min_words`` words or more share a kept suffix. Suffixes whose minimiser
occurs once are dropped by a grouped count; the others get the words around them, meet by minimiser,
are sorted by what follows (a suffix array) and, reversed, by what precedes. Neighbours' common
prefix lengths cut both orders into classes; a window of l words before and r after the position is
repeated exactly if another suffix shares its class at l and its class at r. So every match is extended
left and right, not only that of neighbours, without comparing all pairs. A suffix is extended over the
windows that select it, so each window is met once.

A minimiser of more than ``hot`` suffixes would make a task that grows with its passage. Its suffixes are
split by document into groups of about ``GROUP``. Each group sorts its own suffixes in the same way and sends
one row for each of its classes, however many members that has; classes meet by the hash of their window,
and a group gets back those of its classes that occur in two documents. No member is sent by its window.

A passage counts as repeated if it occurs in two different documents. Of each repeated window the
occurrence of the smallest (doc_id, position) is the first; ``cut`` takes the others out.

Words are runs of anything but ASCII white space. They are compared by 32 bits of their XXH64, all words of a
window in turn, and the classes of split minimisers by 128 bits over these. Texts of fewer than ``min_words``
words, null and empty ones have no passages. Rows that repeat an id and a text are one document; rows with one
id but different texts are different documents. Ids are of any type that sorts; null ids take part, and are first.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from strata.llm.common import raw_texts, staged, unstage
from strata.llm.hashing import STEP, mixed, run_hashes, word_hashes

MIN_WORDS, K = 50, 8
#: Suffixes compared at once, but for a single larger group.
CHUNK = 30_000
#: Suffixes of one minimiser from which on they are split by document, and suffixes in such a group, about.
HOT, GROUP = 5_000, 4_096
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost least value of each window, by doubling."""
    n = len(values) - width + 1
    at, size = np.arange(len(values)), 1
    while size < width:
        step = min(size, width - size)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(values[right] < values[left], right, left)
        size += step
    return at[:n]


def minimisers(h: np.ndarray, min_words: int = MIN_WORDS, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of a document's kept suffixes, from its words' hashes."""
    if len(h) < min_words:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    runs = run_hashes(h, k)
    at = np.unique(_least(runs, min_words - k + 1))
    return at, runs[at]


def _suffixes(docs: DataFrame, min_words: int) -> DataFrame:
    """A row for each document and minimiser: key, and the positions ``ats`` of the suffixes that begin with it."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows, keys, lists, sizes = [], [], [], []
            for i, raw in enumerate(raw_texts(batch.column(2))):
                at, key = minimisers(word_hashes(raw.split()), min_words)
                order = np.argsort(key, kind="stable")
                own, n = np.unique(key, return_counts=True)
                rows.append(np.full(len(own), i))
                keys.append(own)
                lists.append(at[order])
                sizes.append(n)
            joined = lambda parts, kind: np.concatenate([*parts, np.zeros(0, kind)]).astype(kind)
            offsets = np.concatenate(([0], np.cumsum(joined(sizes, np.int64)))).astype(np.int32)
            take = pa.array(joined(rows, np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(take), batch.column(1).take(take), pa.array(joined(keys, np.uint64).view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(joined(lists, np.int32))),
                ],
                names=["doc_id", "h", "key", "ats"],
            )

    return docs.mapInArrow(run, f"doc_id {id_type}, h long, key long, ats array<int>")


#: Of a suffix, or in lists of some thousand suffixes of a document.
CONTEXT = "at int, least int, most int, key long, around binary"
CONTEXTS = "at array<int>, least array<int>, most array<int>, key array<long>, around binary"


def _contexts(df: DataFrame, min_words: int, lists: bool = False) -> DataFrame:
    """Rows (doc_id, h, text, ats) to a row for each suffix, or with ``lists`` to one for many of a document's.

    ``around`` has the 32-bit hashes of the words around it; ``least`` and ``most`` are the numbers of words
    before it in the windows that select it.
    """
    id_type = df.schema["doc_id"].dataType.simpleString()
    before, after = min_words - K, min_words

    def run(batches):
        for batch in batches:
            for i, raw in enumerate(raw_texts(batch.column(2))):
                h = word_hashes(raw.split())
                runs = run_hashes(h, K)
                select = _least(runs, before + 1)
                wanted = np.zeros(len(runs), bool)
                wanted[np.array(batch.column(3)[i].as_py(), np.int64)] = True
                start = np.flatnonzero(wanted[select])
                at, first, n = np.unique(select[start], return_index=True, return_counts=True)
                most, least = at - start[first], at - start[first + n - 1]
                short = np.concatenate((np.zeros(before, np.uint32), (h >> np.uint64(32)).astype(np.uint32), np.zeros(after, np.uint32)))
                around = np.lib.stride_tricks.sliding_window_view(short, before + after)
                for low in range(0, len(at), 4096):
                    part = slice(low, low + 4096)
                    n = len(at[part])
                    columns = [*(pa.array(x[part].astype(np.int32)) for x in (at, least, most)), pa.array(runs[at[part]].view(np.int64))]
                    if lists:
                        columns = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), c) for c in columns]
                    words = [around[at[part]].tobytes()] if lists else [row.tobytes() for row in around[at[part]]]
                    n = len(words)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([batch.column(0)[i].as_py()] * n, batch.schema.field(0).type),
                            pa.array([batch.column(1)[i].as_py()] * n, pa.int64()), *columns, pa.array(words, pa.binary()),
                        ],
                        names=["doc_id", "h", "at", "least", "most", "key", "around"],
                    )

    return df.mapInArrow(run, f"doc_id {id_type}, h long, {CONTEXTS if lists else CONTEXT}")


def _classes(rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of a suffix array over the rows' words, and each one's common prefix with its predecessor there.

    Rows of different groups have a common prefix of -1.
    """
    n, width = rows.shape
    wide = np.empty((n, width + 1), ">u4")
    wide[:, 0], wide[:, 1:] = group, rows
    order = np.argsort(np.ascontiguousarray(wide).view(f"V{4 * (width + 1)}").ravel(), kind="stable")
    wide = wide[order]
    same = wide[1:] == wide[:-1]
    prefix = np.where(same.all(axis=1), width + 1, np.argmin(same, axis=1)) - 1
    return order, np.concatenate(([-1], prefix))


def _by_window(group, doc, at, least, most, around, min_words: int):
    """For each number of words before the suffixes: the rows with a window there, by class and place, and which begin a class.

    ``group`` and ``doc`` are small integers, doc in the order of (doc_id, h).
    """
    before = around.shape[1] - min_words
    right, right_lcp = _classes(around[:, before:], group)
    left, left_lcp = _classes(around[:, :before][:, ::-1], group)
    n = len(group)
    place = doc.astype(np.int64) << 32 | at
    of_right, of_left = np.empty(n, np.int64), np.empty(n, np.int64)
    for l in range(before + 1):  # noqa: E741
        rows = np.flatnonzero((least <= l) & (l <= most))
        if not len(rows):
            continue
        of_right[right] = np.cumsum(right_lcp < min_words - l)
        of_left[left] = np.cumsum(left_lcp < l)
        key = of_right[rows] * (n + 1) + of_left[rows]
        order = np.lexsort((place[rows], key))
        rows, key = rows[order], key[order]
        yield l, rows, np.concatenate(([True], key[1:] != key[:-1]))


class _Found:
    """Spans of suffixes whose windows are repeated: all of them, and those of windows that aren't first occurrences."""

    def __init__(self, at: np.ndarray, min_words: int):
        self.at, self.min_words = at, min_words
        none = np.full(len(at), np.iinfo(np.int64).max)
        self.low, self.cut_low, self.first = none, none.copy(), none.copy()
        self.high, self.cut_high = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)

    def add(self, l: int, rows: np.ndarray, leader: np.ndarray, lead: np.ndarray) -> None:  # noqa: E741
        """``leader``: the first document, as a small integer; ``lead``: whether the row is the first occurrence itself."""
        start = self.at[rows] - l
        self.low[rows] = np.minimum(self.low[rows], start)
        self.high[rows] = np.maximum(self.high[rows], start + self.min_words)
        self.first[rows] = np.minimum(self.first[rows], leader)
        later, start = rows[~lead], start[~lead]
        self.cut_low[later] = np.minimum(self.cut_low[later], start)
        self.cut_high[later] = np.maximum(self.cut_high[later], start + self.min_words)

    def batch(self, places: list, doc: np.ndarray, id_type: pa.DataType) -> pa.RecordBatch:
        """A row for each of a document's spans, those that overlap made one."""
        rows, later = np.flatnonzero(self.high), np.flatnonzero(self.cut_high)
        cut, low, high = _united(doc[later], self.cut_low[later], self.cut_high[later])
        whole, start, end = _united(doc[rows], self.low[rows], self.high[rows])
        known = dict.fromkeys(zip(cut.tolist(), low.tolist(), high.tolist(), strict=True))  # what is cut is repeated too
        more = np.array([x not in known for x in zip(whole.tolist(), start.tolist(), end.tolist(), strict=True)], bool)
        none = np.zeros(int(more.sum()), np.int64)
        at = np.concatenate((cut, whole[more]))
        first = np.full(len(places), np.iinfo(np.int64).max)
        np.minimum.at(first, doc[rows], self.first[rows])
        of = lambda i, c, kind: pa.array([places[k][c] for k in i.tolist()], kind)
        spans = np.concatenate((low, start[more])), np.concatenate((high, end[more])), np.concatenate((low, none)), np.concatenate((high, none))
        return pa.RecordBatch.from_arrays(
            [of(at, 0, id_type), of(at, 1, pa.int64()), *(pa.array(x.astype(np.int32)) for x in spans), of(first[at], 0, id_type)],
            names=["doc_id", "h", "start", "end", "cut_start", "cut_end", "first_doc_id"],
        )


def _united(doc: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of documents, those of one that meet made one."""
    order = np.lexsort((low, doc))
    base = doc[order] << 32
    low, high = base | low[order], np.maximum.accumulate(base | high[order])
    new = np.flatnonzero(np.concatenate(([True], low[1:] > high[:-1]))) if len(low) else np.zeros(0, np.int64)
    end = np.append(new[1:], len(low))[: len(new)] - 1
    return low[new] >> 32, low[new] & 0xFFFFFFFF, high[end] & 0xFFFFFFFF


def _documents(ids: list, hashes: list) -> tuple[list, dict]:
    """The distinct (doc_id, h) in order, null ids first, and each one's number."""
    places = sorted(set(zip(ids, hashes, strict=True)), key=lambda x: (x[0] is not None, *x))
    return places, {x: i for i, x in enumerate(places)}


def _flat(t: pa.Table, name: str) -> np.ndarray:
    """A value for each suffix, of rows of either kind."""
    column = t.column(name)
    return (pc.list_flatten(column) if pa.types.is_list(column.type) else column).to_numpy()


def _numbers(t: pa.Table, number: dict) -> np.ndarray:
    """Each suffix's document."""
    doc = np.array([number[x] for x in zip(t.column("doc_id").to_pylist(), t.column("h").to_pylist(), strict=True)], np.int64)
    at = t.column("at")
    return np.repeat(doc, pc.list_value_length(at).to_numpy()) if pa.types.is_list(at.type) else doc


def _columns(t: pa.Table, min_words: int):
    """Numbers of the keys and documents, and what else ``_by_window`` takes."""
    places, number = _documents(t.column("doc_id").to_pylist(), t.column("h").to_pylist())
    doc = _numbers(t, number)
    group = np.unique(_flat(t, "key"), return_inverse=True)[1]
    at, least, most = (_flat(t, c).astype(np.int64) for c in ("at", "least", "most"))
    around = np.frombuffer(b"".join(x.as_py() for x in t.column("around")), np.uint32).reshape(-1, 2 * min_words - K)
    return places, doc, (group, doc, at, least, most, around, min_words)


def _compare_sorted(batches, min_words: int):
    """Whole groups of the rows sorted by key, a chunk at a time."""

    def flush(t: pa.Table):
        key = t.column("key").to_numpy()
        _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
        t = t.filter(pa.array(counts[inverse] > 1))
        if not t.num_rows:
            return
        places, doc, columns = _columns(t, min_words)
        found = _Found(columns[2], min_words)
        for l, rows, new in _by_window(*columns):  # noqa: E741
            begin = np.flatnonzero(new)
            end = np.append(begin[1:], len(rows)) - 1
            of = np.cumsum(new) - 1
            leader = doc[rows[begin]]
            held = (leader != doc[rows[end]])[of]
            found.add(l, rows[held], leader[of][held], new[held])
        yield found.batch(places, doc, t.schema.field("doc_id").type)

    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < CHUNK:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        key = t.column("key").to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        if cut:
            yield from flush(t.slice(0, cut))
        held, n = t.slice(cut).combine_chunks().to_batches(), t.num_rows - cut
    if n:
        yield from flush(pa.Table.from_batches(held).combine_chunks())


def _window_hashes(around: np.ndarray, l: int, min_words: int) -> tuple[np.ndarray, np.ndarray]:  # noqa: E741
    """128 bits over the words of each row's window with l words before the suffix."""
    low = around.shape[1] - min_words - l
    a = np.zeros(len(around), np.uint64)
    b = np.full(len(around), STEP)
    for word in around[:, low : low + min_words].T.astype(np.uint64):
        a = a * STEP + word
        b = mixed(b ^ word)
    return mixed(a).view(np.int64), b.view(np.int64)


def _split(spark: SparkSession, contexts: DataFrame, groups: int, min_words: int) -> DataFrame:
    """The same as ``_compare_sorted`` for minimisers whose suffixes are split by document."""
    id_type = contexts.schema["doc_id"].dataType
    arrow_id, id_name = to_arrow_type(id_type), id_type.simpleString()
    rows = staged(spark, contexts.withColumn("g", F.pmod(F.xxhash64("doc_id", "h"), F.lit(groups)).cast("int")), "split")

    def summarise(t: pa.Table) -> pa.Table:
        places, doc, columns = _columns(t, min_words)
        at, around = columns[2], columns[5]
        parts = []
        for l, order, new in _by_window(*columns):  # noqa: E741
            begin = np.flatnonzero(new)
            end = np.append(begin[1:], len(order)) - 1
            lead, last = order[begin], order[end]
            parts.append((*_window_hashes(around[lead], l, min_words), doc[lead], at[lead] - l, doc[last]))
        a, b, first, start, last = (np.concatenate(x) for x in zip(*parts, strict=True))
        of = lambda at, c, kind: pa.array([places[i][c] for i in at.tolist()], kind)
        g = pa.array(np.full(len(a), t.column("g")[0].as_py(), np.int32))
        return pa.table(
            [g, pa.array(a), pa.array(b), of(first, 0, arrow_id), of(first, 1, pa.int64()), pa.array(start.astype(np.int32)), of(last, 0, arrow_id), of(last, 1, pa.int64())],
            names=["g", "a", "b", "doc_id", "h", "start", "last_id", "last_h"],
        )

    schema = f"g int, a long, b long, doc_id {id_name}, h long, start int, last_id {id_name}, last_h long"
    sent = staged(spark, rows.groupBy("g").applyInArrow(summarise, schema), "classes")
    shared = sent.groupBy("a", "b").agg(F.min(F.struct("doc_id", "h", "start")).alias("first"), F.max(F.struct("last_id", "last_h")).alias("last"))
    shared = shared.where("not (first.doc_id <=> last.last_id and first.h <=> last.last_h)").select("a", "b", "first")
    back = sent.select("g", "a", "b").join(shared, ["a", "b"]).select("g", "a", "b", "first.doc_id", "first.h", "first.start")

    def apply(t: pa.Table, known: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        first = {(a, b): (d, h, s) for a, b, d, h, s in zip(*(known.column(c).to_pylist() for c in ("a", "b", "doc_id", "h", "start")), strict=True)}
        ids, hashes = t.column("doc_id").to_pylist(), t.column("h").to_pylist()
        places, number = _documents([*ids, *(x[0] for x in first.values())], [*hashes, *(x[1] for x in first.values())])
        doc = _numbers(t, number)
        at, least, most, around = _columns(t, min_words)[2][2:6]
        found = _Found(at, min_words)
        for l in range(int(least.min(initial=0)), int(most.max(initial=-1)) + 1):  # noqa: E741
            rows = np.flatnonzero((least <= l) & (l <= most))
            answers = [first.get(x) for x in zip(*(x.tolist() for x in _window_hashes(around[rows], l, min_words)), strict=True)]
            held = np.array([x is not None for x in answers], bool)
            leader = np.array([number[x[0], x[1]] for x in answers if x], np.int64)
            start = np.array([x[2] for x in answers if x], np.int64)
            rows = rows[held]
            found.add(l, rows, leader, (leader == doc[rows]) & (start == at[rows] - l))
        return pa.Table.from_batches([found.batch(places, doc, arrow_id)])

    return rows.groupBy("g").cogroup(back.groupBy("g")).applyInArrow(apply, _spans_schema(id_name))


def _spans_schema(id_name: str) -> str:
    return f"doc_id {id_name}, h long, start int, end int, cut_start int, cut_end int, first_doc_id {id_name}"


def _merge_spans(pairs: list) -> list[list[int]]:
    out: list[list[int]] = []
    for start, end in sorted(pairs):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def repeats(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS, hot: int = HOT, group: int = GROUP) -> DataFrame:
    """A row for each document of ``docs(doc_id, text)`` that shares a passage with another.

    ``doc_id``, ``h`` (hash of its text), ``spans`` and ``cuts`` (word positions of its repeated
    passages, and of those that aren't first occurrences: arrays of (start, end), end exclusive)
    and ``first_doc_id``, the smallest document that one of its passages occurs in.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    suffixes = staged(spark, _suffixes(keyed, min_words), "suffixes")
    shared = suffixes.groupBy("key").agg(F.count("*").alias("n_docs"), F.sum(F.size("ats")).alias("n")).where("n_docs > 1")
    shared = suffixes.join(shared.select("key", (F.col("n") > hot).alias("hot")), "key").select("doc_id", "h", "ats", "hot")
    shared = staged(spark, shared, "shared")
    unstage(spark, suffixes)
    of = lambda c: F.flatten(F.collect_list(F.when(c, F.col("ats"))))
    wanted = staged(spark, shared.groupBy("doc_id", "h").agg(of(~F.col("hot")).alias("ats"), of(F.col("hot")).alias("hots")), "wanted")
    unstage(spark, shared)
    n_hot = wanted.agg(F.sum(F.size("hots"))).first()[0] or 0
    wanted = wanted.withColumnsRenamed({"doc_id": "d", "h": "g"})
    on = F.col("doc_id").eqNullSafe(F.col("d")) & F.col("h").eqNullSafe(F.col("g"))

    def contexts(which: str) -> DataFrame:
        own = wanted.where(F.size(which) > 0).hint("shuffle_hash")
        return _contexts(keyed.join(own, on).select("doc_id", "h", "text", which), min_words, which == "hots")

    found = contexts("ats").repartition("key").sortWithinPartitions("key").mapInArrow(lambda batches: _compare_sorted(batches, min_words), _spans_schema(id_type))
    if n_hot:
        found = found.unionByName(_split(spark, contexts("hots"), n_hot // group + 1, min_words))
    grouped = found.groupBy("doc_id", "h").agg(
        F.collect_list(F.struct("start", "end")).alias("spans"),
        F.collect_list(F.when(F.col("cut_end") > 0, F.struct(F.col("cut_start").alias("start"), F.col("cut_end").alias("end")))).alias("cuts"),
        F.min(F.struct("first_doc_id"))["first_doc_id"].alias("first_doc_id"),
    )
    span = "array<struct<start:int,end:int>>"
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def merge(batches):
        for batch in batches:
            columns = [
                pa.array([[{"start": s, "end": e} for s, e in _merge_spans([(x["start"], x["end"]) for x in row])] for row in batch.column(i).to_pylist()], kind)
                for i in (2, 3)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, batch.column(4)], names=["doc_id", "h", "spans", "cuts", "first_doc_id"])

    return grouped.mapInArrow(merge, f"doc_id {id_type}, h long, spans {span}, cuts {span}, first_doc_id {id_type}")


def without(raw: bytes, cuts: list[tuple[int, int]]) -> str:
    """The text without the words of the cuts and the white space after each of them."""
    starts = [m.start() for m in WORD.finditer(raw)] + [len(raw)]
    kept, at = [], 0
    for start, end in cuts:
        kept.append(raw[at : starts[start]])
        at = starts[end]
    return b"".join([*kept, raw[at:]]).decode().strip()


def cut_repeats(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with all but the first occurrence of each repeated passage taken out of their texts.

    A column ``n_chars`` is set to the new text's length where the text changes. Documents that
    hold nothing else are dropped; all others stay, and those without repeats are unchanged.
    """
    found = staged(spark, repeats(spark, docs, min_words), "repeats").where(F.size("cuts") > 0)
    found = found.select(F.col("doc_id").alias("_strata_d"), F.col("h").alias("_strata_h"), F.col("cuts").alias("_strata_cuts"))
    on = F.col("doc_id").eqNullSafe(F.col("_strata_d")) & F.xxhash64("text").eqNullSafe(F.col("_strata_h"))
    joined = docs.join(found.hint("shuffle_hash"), on, "left").select(*docs.columns, "_strata_cuts")
    at, count = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    names = docs.columns

    def run(batches):
        for batch in batches:
            columns = list(batch.columns[:-1])
            if batch.column(len(names)).null_count < batch.num_rows:
                texts, cuts = columns[at].to_pylist(), batch.column(len(names)).to_pylist()
                sizes = columns[count].to_pylist() if count is not None else None
                for i, own in enumerate(cuts):
                    if own:
                        texts[i] = without(texts[i].encode(), [(x["start"], x["end"]) for x in own])
                        if sizes is not None:
                            sizes[i] = len(texts[i])
                columns[at] = pa.array(texts, columns[at].type)
                if sizes is not None:
                    columns[count] = pa.array(sizes, columns[count].type)
                keep = pa.array([not own or bool(t) for own, t in zip(cuts, texts, strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays(columns, names=names).filter(keep)
            else:
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(run, docs.schema)
