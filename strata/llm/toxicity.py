"""Toxicity scores of restored text.

Noisy channel: whatever looks disguised (digits or signs among letters, separators among letters, letters and
signs apart, a letter three times or more) becomes a lattice of what each character may stand for: itself, the
letters a sign is written for, nothing (separators, repeats) or a word break. A Viterbi search under a character
trigram model of the whole corpus picks the likeliest reading, and the likeliest without breaks for signs. A token
is cut at its punctuation; where separators stand inside, its parts are read and the whole is, as either may be
meant. Digits without a letter stay numbers. The restored text's words and their beginnings are the features of a
logistic regression.

The character model counts all texts. The classifier is fitted on at most ``max_rows`` labelled rows, taken by a
hash of their id; its features are the ``features`` of these rows' words and word beginnings, hashed, that tell
most about the label. All of a text is read. Null and empty texts get the score of no feature.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import raw_texts, staged

MAX_ROWS, FEATURES, BUCKETS = 20_000, 4096, 1 << 20
#: Lengths of the word beginnings that are features, and documents a feature must occur in.
BEGINNINGS, LEAST_DOCS = (3, 4, 5, 6), 3
CACHE = 400_000

#: What signs are written for. Fixed values.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i",
}
SEPARATORS = " \t\n\r.-_*~·,/\\"
#: Log costs of the channel.
SIGN, REPEAT, DROP, BREAK = -1.0, -0.7, -0.3, -4.0
ALPHABET = 28  # a break, a to z, any other letter

LETTERS = bytes(c - 0x40 if 0x41 <= c <= 0x5A else c - 0x60 if 0x61 <= c <= 0x7A else 27 if c >= 0xC0 else 0 for c in range(256))
INNER = bytes(range(0x80, 0xC0))
#: Character classes: letters and digits; the other signs of LEET; SEPARATORS.
SIGNS, BETWEEN = re.escape("".join(c for c in LEET if not c.isalnum())), re.escape(SEPARATORS)
#: Single letters and signs apart; what punctuation leaves of a token; its separators.
SPACED = re.compile(rf"(?<![^\W_])(?!_)[\w{SIGNS}](?:[\s{BETWEEN}]+(?!_)[\w{SIGNS}]){{2,}}(?![^\W_])")
RUN = re.compile(rf"[\w{SIGNS}{BETWEEN}]+")
CUT = re.compile(rf"[\s{BETWEEN}]+")
PLAIN = re.compile(r"[^\W\d_]+")
TRIPLE = re.compile(r"([^\W\d_])\1\1")
#: Signs at an edge are punctuation, or letters in a second reading if they are seldom punctuation there.
EDGE = re.compile(r"^[^\w@$€]+|[^\w]+$")
WIDE = re.compile(r"^[^\w@$€£¡!|+]+|[^\w@$€£¡|+]+$")


def symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0


class CharacterModel:
    def __init__(self, counts: np.ndarray):
        counts = counts.astype(float) + 0.1
        self.logs = np.log(counts / counts.sum(axis=2, keepdims=True)).tolist()


def character_counts(docs: DataFrame) -> np.ndarray:
    """Symbol trigrams of all texts; ALPHABET ** 3 numbers."""

    def run(batches):
        total = np.zeros(ALPHABET**3, np.int64)
        for batch in batches:
            for raw in raw_texts(batch.column(0)):
                x = np.frombuffer(raw.translate(LETTERS, INNER), np.uint8)
                for low in range(0, len(x) - 2, 1 << 18):
                    y = x[low : low + (1 << 18) + 2].astype(np.int32)
                    total += np.bincount((y[:-2] * ALPHABET + y[1:-1]) * ALPHABET + y[2:], minlength=ALPHABET**3)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["i", "n"])

    counts = np.zeros(ALPHABET**3, np.int64)
    for r in docs.select("text").mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r.i] = r.n
    return counts.reshape(ALPHABET, ALPHABET, ALPHABET)


def lattice(observed: str, breaks: bool = True):
    """For each place the readings (text, log cost); without ``breaks`` signs are letters only."""
    i, n = 0, len(observed)
    while i < n:
        c, j = observed[i], i + 1
        while j < n and observed[j] == c:
            j += 1
        if c.isalpha():
            if j - i >= 3:
                yield [(c, REPEAT), (c + c, REPEAT)]
            else:
                yield [(c * (j - i), 0.0)]
        elif c in LEET:
            for _ in range(min(j - i, 2)):
                yield [(x, SIGN) for x in LEET[c]] + ([(" ", BREAK)] if breaks else [])
        elif c in SEPARATORS or c.isspace():
            yield [("", DROP), (" ", BREAK)]
        else:
            yield [(" ", 0.0)]
        i = j


def restore(observed: str, model: CharacterModel, breaks: bool = True) -> str:
    """The likeliest reading of a disguised token or run of letters."""
    logs = model.logs
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for readings in [*lattice(observed, breaks), [(" ", 0.0)]]:
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, path) in best.items():
            for text, cost in readings:
                x, y, total = a, b, score + cost
                for c in text:
                    z = symbol(c)
                    if z == 0 and y == 0:
                        continue
                    total += logs[x][y][z]
                    x, y = y, z
                if (x, y) not in after or total > after[x, y][0]:
                    after[x, y] = total, (path, text) if text else path
        best = after
    path, parts = max(best.values(), key=lambda v: v[0])[1], []
    while path:
        path, text = path
        parts.append(text)
    return "".join(reversed(parts)).strip()


def disguised(core: str) -> bool:
    """Whether a token without its punctuation should be decoded."""
    if core.isalpha():
        return bool(TRIPLE.search(core))
    return any(c.isalpha() for c in core) and any(c in LEET or c in SEPARATORS for c in core)


def restored(core: str, model: CharacterModel) -> list[str]:
    """Words of the likeliest reading, and of the likeliest with a letter for every sign."""
    found = PLAIN.findall(restore(core, model))
    if any(c in LEET for c in core):
        found += PLAIN.findall(restore(core, model, breaks=False))
    return found


def words_of(token: str, model: CharacterModel) -> list[str]:
    found: list[str] = []
    for run in RUN.findall(token):
        parts = [p for p in CUT.split(run) if p]
        apart = len(parts) > 2 and all(len(p) == 1 for p in parts)
        for part in [*([] if apart else parts), *([run] if len(parts) > 1 else [])]:
            for core in {EDGE.sub("", part): 0, WIDE.sub("", part): 0}:
                found += restored(core, model) if disguised(core) else PLAIN.findall(core)
    return list(dict.fromkeys(found))


def words_apart(text: str, model: CharacterModel) -> set[str]:
    """Words of which single letters and signs stand apart.

    One before them may be a word of its own and signs around them numbers, so each run is also read without these.
    """
    found: set[str] = set()
    for run in SPACED.finditer(text):
        letters = [i for i, c in enumerate(run[0]) if c.isalpha()]
        if letters:
            spans = {(0, len(run[0])), (CUT.search(run[0]).end(), len(run[0])), (letters[0], letters[-1] + 1)}
            for low, high in spans:
                found.update(restored(run[0][low:high], model))
    return found


def beginnings(word: str) -> list[int]:
    raw = [word, *(word[:k] + "*" for k in BEGINNINGS if len(word) > k)]
    return [xxhash.xxh32_intdigest(x) % BUCKETS for x in raw]


class Reader(dict):
    """Tokens to the hashed features of their restored words; a worker's memory of them."""

    def __init__(self, model: CharacterModel, weight: dict[int, int] | None = None):
        self.model, self.weight = model, weight

    def __missing__(self, token: str) -> tuple[int, ...]:
        found = {i for word in words_of(token, self.model) for i in beginnings(word)}
        if self.weight is not None:
            found = {self.weight[i] for i in found if i in self.weight}
        if len(self) >= CACHE:
            self.clear()
        if len(token) <= 64:
            self[token] = tuple(found)
        return tuple(found)

    def read(self, text: str) -> set[int]:
        text = text.lower()
        tokens = text.split()
        found: set[int] = set()
        for word in words_apart(text, self.model):
            found.update(self[word])
        for ids in map(self.__getitem__, set(tokens)):
            if ids:
                found.update(ids)
        return found


@dataclass
class Classifier:
    characters: CharacterModel
    index: dict[int, int]  # hashed feature to its weight's place
    weights: np.ndarray
    bias: float


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4 == 2


def _read_rows(rows: DataFrame, model: CharacterModel) -> DataFrame:
    """(label, text) to (label, ids)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        reader = Reader(shared.value)
        for batch in batches:
            ids = [sorted(reader.read(raw.decode())) for raw in raw_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["label", "ids"])

    return rows.mapInArrow(run, "label int, ids array<int>")


def _only(rows: DataFrame, index: dict[int, int]) -> DataFrame:
    """(label, ids) with the places of the ids that ``index`` has."""

    def run(batches):
        for batch in batches:
            ids = [[index[i] for i in own if i in index] for own in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["label", "ids"])

    return rows.mapInArrow(run, "label int, ids array<int>")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS, features: int = FEATURES) -> Classifier:
    """From ``docs(doc_id, text)`` and ``labels(doc_id, label)``, of rows that aren't held out."""
    characters = CharacterModel(character_counts(docs))
    usable = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col(label).cast("int").alias("label"))
    picked = staged(docs.sparkSession, usable.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_rows), "picked")
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("label", "text")  # no text has to move
    read = staged(docs.sparkSession, _read_rows(sample, characters), "sample")
    size = read.groupBy("label").count().collect()
    total = {r.label: r["count"] for r in size}
    pos, neg = max(1, total.get(1, 0)), max(1, sum(v for k, v in total.items() if k != 1))
    seen = read.select("label", F.explode("ids").alias("id")).groupBy("id").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") != 1).alias("q"))
    p, q = (F.col("p") + 0.5) / (pos + 1), (F.col("q") + 0.5) / (neg + 1)
    telling = F.abs(p - q) * F.abs(F.log(p / q))
    top = seen.where(F.col("p") + F.col("q") >= LEAST_DOCS).orderBy(telling.desc(), "id").limit(features).select("id").collect()
    index = {r.id: i for i, r in enumerate(top)}
    y, rows, columns = [], [], []
    chosen = _only(read, index).toPandas()  # at most max_rows rows of ids under ``features``
    for i, (value, ids) in enumerate(zip(chosen["label"], chosen["ids"], strict=True)):
        y.append(float(value == 1))
        rows += [i] * len(ids)
        columns += list(ids)
    weights, bias = logistic(np.array(y), np.array(rows, np.int64), np.array(columns, np.int64), len(index))
    return Classifier(characters, index, weights, bias)


def logistic(y: np.ndarray, rows: np.ndarray, columns: np.ndarray, size: int, steps: int = 300, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights of a logistic regression on sparse binary features, by full gradient steps with adaptive sizes."""
    w, b, gw, gb = np.zeros(size), 0.0, np.full(size, 1e-8), 1e-8
    if not len(y):
        return w, b
    b = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    for _ in range(steps):
        z = b + np.bincount(rows, w[columns], len(y))
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        g = np.bincount(columns, error[rows], size) + penalty * w
        gw += g * g
        gb += error.sum() ** 2
        w -= 0.3 * g / np.sqrt(gw)
        b -= 0.05 * error.sum() / np.sqrt(gb)
    return w, b


def score(docs: DataFrame, model: Classifier, threshold: float = 0.3) -> DataFrame:
    """A row for each row of ``docs(doc_id, text)``: doc_id, held_out, score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        reader = Reader(own.characters, own.index)
        for batch in batches:
            z = np.array([own.bias + own.weights[np.fromiter(reader.read(raw.decode()), np.int64)].sum() for raw in raw_texts(batch.column(1))])
            p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, score double, predicted int")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    return score(docs, fit(docs, labels, max_rows=max_rows))
