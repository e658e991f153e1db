"""Token ids as flat binary files with 64-bit document offsets, and their reader.

A store is a folder of parts. Part k holds ``<name>.bin`` (little-endian unsigned ids, 16 bits
where the vocabulary allows it, else 32), ``<name>.idx`` (64-bit offsets, one more than it has
documents, counted in ids from the part's start) and ``<name>.ids`` (64-bit document ids). The
manifest lists the parts in document order with their bases: the prefix sums of the parts' counts.

Documents are range-partitioned by (doc_id, hash of the text), so repeated ids spread as well, and
sorted in each part. A task writes under a name of its own attempt and only names that a finished
task has returned come into the manifest: a lost executor's half-written files are never read.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from dataclasses import asdict, dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words remembered by a worker in each of two generations, the longest of them in bytes, and bytes of text encoded at once.
CACHE, CACHED_LENGTH, TEXT_BYTES = 400_000, 64, 4 << 20
#: Stands in an .ids file for a null document id.
NO_ID = np.iinfo("<i8").min


@dataclass(frozen=True)
class Part:
    name: str
    order: int
    docs: int
    tokens: int
    base: int = 0


#: A run of letters, whatever stands beside it: ASCII ones, and Latin ones that lower-casing leaves one letter.
LETTERS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xc4[\x80-\xaf\xb1-\xbf]|[\xc5-\xc8][\x80-\xbf])+")
#: Bytes of texts without combining marks; in these a letter may be lower-cased before it is normalised.
COMMON = bytes([*range(0x80), *range(0x80, 0xC0), *range(0xC3, 0xC9)])
#: Classes of bytes: white space, letters, digits, signs. A chunk between white space with any other byte, among them
#: apostrophes (which may begin a contraction), control characters and leading bytes of other scripts, stays whole.
SPACE, LETTER, DIGIT, SIGN, OTHER = range(5)
CLASS = np.full(256, OTHER, np.uint8)
CLASS[[*b" \t\n\r\x0b\x0c"]] = SPACE
CLASS[0x21:0x7F] = SIGN
CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xC0), *range(0xC3, 0xC9)]] = LETTER
CLASS[0x30:0x3A] = DIGIT
CLASS[0x27] = OTHER


def cut(x: np.ndarray, cuts_words: bool) -> tuple[np.ndarray, np.ndarray]:
    """Where the parts of a text's bytes begin, and which bytes aren't white space.

    Parts are the chunks between white space, and with ``cuts_words`` the runs of letters or signs and the
    single digits in them.
    """
    kind = CLASS[x]
    space = kind == SPACE
    change = space[1:] != space[:-1]
    if cuts_words:
        odd = kind == OTHER
        lead, rest = x[:-1], x[1:]
        odd[:-1] |= (lead == 0xC3) & ((rest == 0x97) | (rest == 0xB7)) | (lead == 0xC4) & (rest == 0xB0)
        inner = kind[1:] != kind[:-1]
        inner |= kind[1:] == DIGIT
        if odd.any():
            chunk = np.cumsum(np.concatenate(([False], change)))
            whole = np.zeros(chunk[-1] + 1, bool)
            whole[chunk[odd]] = True
            inner &= ~whole[chunk[1:]]
        change |= inner
    begins = np.concatenate(([True], change)) & ~space
    return np.flatnonzero(begins), ~space


class WordCache(dict):
    """Ids of parts of texts, as little-endian bytes; two generations, so frequent ones stay.

    White space ends a token and no normalisation reaches across it in the tokenizers this is used with
    (``splits_at_space``), so a text's ids are its chunks' ids in turn. Where the tokenizer also
    lower-cases and cuts letters, digits and signs apart (``cuts_words``), they are its parts'.
    """

    def __init__(self, tokenizer, dtype: str, cuts_words: bool):
        self.tokenizer, self.dtype, self.cuts_words = tokenizer, dtype, cuts_words
        self.old: dict[bytes, bytes] = {}
        vocabulary = tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)  # ids that end a word
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def remember(self, part: bytes, ids: bytes) -> None:
        if len(part) > CACHED_LENGTH:
            return
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        self[part] = ids

    def encode(self, part: bytes) -> bytes:
        return np.array(self.tokenizer.encode(part.decode(), add_special_tokens=False).ids, self.dtype).tobytes()

    def _encode_words(self, words: list[bytes]):
        """(word, ids) of runs of letters: many in one run, which costs less than one by one."""
        for low in range(0, len(words), 500):
            run = words[low : low + 500]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(run).decode()], add_special_tokens=False)[0].ids, self.dtype)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(run):  # a word that isn't one run of letters to the tokenizer
                yield from ((w, self.encode(w)) for w in run)
                continue
            data, start = ids.tobytes(), 0
            for w, end in zip(run, (ends * ids.itemsize).tolist(), strict=True):
                yield w, data[start:end]
                start = end

    def look_up(self, parts: list[bytes]) -> list[bytes]:
        """The ids of distinct parts."""
        found = list(map(self.get, parts))
        missing = [i for i, ids in enumerate(found) if ids is None]
        words: dict[bytes, int] = {}
        for i in missing:
            part = parts[i]
            ids = self.old.get(part)
            if ids is None:
                if self.cuts_words and LETTERS.fullmatch(part):
                    words[part] = i
                    continue
                ids = self.encode(part)
            found[i] = ids
            self.remember(part, ids)
        for word, ids in self._encode_words(list(words)):
            found[words[word]] = ids
            self.remember(word, ids)
        return found


@dataclass(frozen=True)
class Loaded:
    tokenizer: object
    dtype: str
    words: WordCache | None  # None if only whole texts can be encoded
    added: tuple[bytes, ...]  # added tokens, lower-cased: texts that hold one are encoded whole


_loaded: dict[str, Loaded] = {}


def load(path: str) -> Loaded:
    """The tokenizer and its word cache, one for each worker process."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        dtype = id_type(t.get_vocab_size())
        spec = json.loads(t.to_str())
        words = WordCache(t, dtype, cuts_words(spec)) if splits_at_space(spec) else None
        _loaded[path] = Loaded(t, dtype, words, tuple(x["content"].lower().encode() for x in spec.get("added_tokens", [])))
    return _loaded[path]


def id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def splits_at_space(spec: dict) -> bool:
    """Whether the tokenizer drops white space before its model, so that words can be encoded one by one."""
    pre = spec.get("pre_tokenizer") or {}
    steps = pre.get("pretokenizers", [pre])
    first = steps[0] if steps else {}
    drops = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True and r"[^\s" in (first.get("pattern") or {}).get("Regex", "")
    return drops or first.get("type") in ("WhitespaceSplit", "Whitespace", "BertPreTokenizer")


def cuts_words(spec: dict) -> bool:
    """Whether it is of the kind that lower-cases and takes runs of letters, single digits and runs of signs as words."""
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    return (
        [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"]
        and [x["type"] for x in pre] == ["Split", "ByteLevel"]
        and pre[0]["pattern"] == {"Regex": pattern}
        and spec["model"].get("end_of_word_suffix") == "</w>"
    )


def _encode_parts(words: WordCache, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of texts in turn, and how many each has; each distinct part is looked up once."""
    dtype = np.dtype(words.dtype)
    x = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    begins, solid = cut(x, words.cuts_words) if len(x) else (np.zeros(0, np.int64), np.zeros(0, bool))
    place = np.concatenate(([0], np.cumsum(solid)))  # of each byte among those that aren't white space
    offsets = np.append(place[begins], place[-1]).astype(np.int64)
    parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(x[solid])])
    coded = parts.dictionary_encode()
    found = words.look_up(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
    size = np.fromiter(map(len, found), np.int64, len(found)) // dtype.itemsize
    ids, first = np.frombuffer(b"".join(found), dtype), np.cumsum(size) - size
    of = coded.indices.to_numpy()
    n = size[of]
    ends = np.concatenate(([0], np.cumsum(n)))
    at = np.repeat(first[of] - ends[:-1], n) + np.arange(ends[-1])
    begun = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return ids[at], np.diff(ends[np.searchsorted(begins, begun)])


def encode_texts(loaded: Loaded, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of whole texts in turn, and how many each has."""
    dtype, words = np.dtype(loaded.dtype), loaded.words
    whole: dict[int, np.ndarray] = {}
    texts = []
    for i, raw in enumerate(raws):
        lower = raw.lower()  # of bytes: ASCII letters only
        if words is None or any(x in lower for x in loaded.added) or not raw.isascii() and any(x in raw.decode().lower().encode() for x in loaded.added):
            whole[i] = np.array(loaded.tokenizer.encode(raw.decode(), add_special_tokens=False).ids, dtype)
            texts.append(b"")
        else:
            texts.append(lower if words.cuts_words and not raw.translate(None, COMMON) else raw)
    if words is None:
        ids, n = np.zeros(0, dtype), np.zeros(len(raws), np.int64)
    else:
        ids, n = _encode_parts(words, texts)
    if whole:
        parts = np.split(ids, np.cumsum(n)[:-1])
        for i, own in whole.items():
            parts[i], n[i] = own, len(own)
        ids = np.concatenate(parts)
    return ids, n


def steps(raws: pa.Array) -> list[list[bytes]]:
    """A batch's texts, null ones empty, by some ``TEXT_BYTES``."""
    out, size = [[]], 0
    for x in raws:
        raw = x.as_py() or b""
        if size + len(raw) > TEXT_BYTES and out[-1]:
            out.append([])
            size = 0
        out[-1].append(raw)
        size += len(raw)
    return out


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None) -> list[Part]:
    """Encode ``docs(doc_id, text)`` with a tokenizers file into a store at ``path`` and commit its manifest.

    A null text is empty, and has the end id alone; a null doc_id comes first. The driver gets
    one row for each part, never one for each document.
    """

    def run(batches):
        loaded = load(tokenizer)
        dtype = np.dtype(loaded.dtype)
        store, root = pafs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        docs_n = tokens = 0
        with (
            store.open_output_stream(f"{root}/{name}.bin") as out,
            store.open_output_stream(f"{root}/{name}.idx") as offsets,
            store.open_output_stream(f"{root}/{name}.ids") as ids,
        ):
            offsets.write(np.zeros(1, "<i8").tobytes())
            for batch in batches:
                for texts in steps(batch.column(1).cast(pa.binary())):
                    data, n = encode_texts(loaded, texts)
                    if end_id is not None:
                        data, n = np.insert(data, np.cumsum(n), end_id), n + 1
                    out.write(data.astype(dtype).tobytes())
                    offsets.write((tokens + np.cumsum(n)).astype("<i8").tobytes())
                    tokens += len(data)
                docs_n += batch.num_rows
                ids.write(batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
        yield pa.RecordBatch.from_pylist(
            [{"name": name, "order": TaskContext.get().partitionId(), "docs": docs_n, "tokens": tokens}]
        )

    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .withColumn("h", F.xxhash64("text"))
        .repartitionByRange("doc_id", "h")
        .sortWithinPartitions("doc_id", "h", "text")
        .select("doc_id", "text")
    )
    rows = ordered.mapInArrow(run, "name string, order long, docs long, tokens long").collect()
    parts, base = [], 0
    for row in sorted(rows, key=lambda r: r.order):
        parts.append(Part(row.name, row.order, row.docs, row.tokens, base))
        base += row.tokens
    store, root = pafs.FileSystem.from_uri(path)
    store.create_dir(root, recursive=True)
    dtype = load(tokenizer).dtype
    with store.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps({"dtype": dtype, "tokens": base, "parts": [asdict(p) for p in parts]}).encode())
    return parts


def manifest(path: str) -> dict:
    store, root = pafs.FileSystem.from_uri(path)
    with store.open_input_stream(f"{root}/manifest.json") as f:
        return json.loads(f.read())


def array(store: pafs.FileSystem, path: str, dtype: str) -> np.ndarray:
    """A file as an array: memory-mapped where the store is a local or mounted file system."""
    if store.get_file_info(path).size == 0:
        return np.zeros(0, dtype)
    if isinstance(store, pafs.LocalFileSystem):
        return np.memmap(path, dtype, "r")
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def read(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """A row for each document of a store: doc_id, start, n_tokens, ids_crc32 and, if asked for, the ids."""
    m = manifest(path)
    dtype = m["dtype"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids

    def run(batches):
        store, root = pafs.FileSystem.from_uri(path)
        for batch in batches:
            for part in batch.to_pylist():
                at = f"{root}/{part['name']}"
                tokens, offsets, names = array(store, f"{at}.bin", dtype), array(store, f"{at}.idx", "<i8"), array(store, f"{at}.ids", "<i8")
                for low in range(0, len(names), 4096):
                    high = min(low + 4096, len(names))
                    spans = [tokens[offsets[i] : offsets[i + 1]].astype("<u4") for i in range(low, high)]
                    columns = [
                        pa.array(names[low:high], mask=names[low:high] == NO_ID),
                        pa.array(offsets[low:high] + part["base"]),
                        pa.array(np.diff(offsets[low : high + 1])),
                        pa.array([crc32(s.tobytes()) for s in spans], pa.int64()),
                    ]
                    if ids:
                        columns.append(pa.array([s.tolist() for s in spans], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * ids])

    parts = spark.createDataFrame(
        [(p["name"], p["base"]) for p in m["parts"] if p["docs"]], "name string, base long"
    )
    return parts.repartition(max(1, len(m["parts"])), "name").mapInArrow(run, schema)
