"""Byte-level BPE encoding and decoding over a hierarchical-bitmap rank queue.

Pre-tokens' bytes form linked lists. Each adjacent pair whose concatenation has a
merge rank is put in that rank's bucket; a two-level bitmap over the ranks tells by
find-first-set which bucket is lowest. An entry whose pair has changed since is
stale and skipped. A merge makes at most two new pairs, so pre-tokens of n bytes cost
O(n log n) whatever their length; nothing is scanned again for the next merge.
Pre-tokens that aren't remembered share one queue, some 16 kB at a time.

Null texts count as empty and have no ids.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from hashlib import sha256
from heapq import heappop, heappush
from itertools import chain, groupby, pairwise
from operator import itemgetter
from sys import byteorder

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from strata.llm.common import remembered

#: Characters after which a very long text is cut at the next place where a match must begin,
#: and after which texts have been looked up and what isn't remembered is merged.
SEGMENT = 1_000_000
#: Pre-tokens, or words of several, remembered by a worker in each of two generations, and the longest of them.
CACHE, CACHED_LENGTH = 300_000, 48
#: Bytes of pre-tokens that share a queue (as much as stays in a core's cache); a longer one has its own.
QUEUE = 1 << 14
#: Bits in a word of the bitmap's lower level.
WORD = 256
BIT = [1 << i for i in range(WORD)]
#: In place of a token: merged into the one before, or a separator; a byte without a token.
GONE, NONE = -1, -2
#: Patterns of which a match begins at each space before a character that isn't white space, and none to its left
#: depends on what follows: white space before such a space is matched by ``\s+(?!\S)``, all else ends at a space.
WORDWISE = frozenset({r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"})
AT_WORD = regex.compile(r" (?=\S)")
BLACK = regex.compile(r"\S").match


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to ranks from a file of base64 tokens and ranks, a pair a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.size = max(ranks.values(), default=0) + 1
        self.pieces = regex.compile(pattern).findall
        self.wordwise = pattern in WORDWISE
        self.vocabulary: list[bytes] = [b""] * self.size
        for token, rank in ranks.items():
            self.vocabulary[rank] = token
        self.decimal = [str(i) for i in range(self.size)]
        self.of_byte = np.array([ranks.get(bytes([x]), NONE) for x in range(256)], np.int32)
        self.of_bytes = np.full(1 << 16, -1, np.int32)  # the rank of each pair of bytes
        for token, rank in ranks.items():
            if len(token) == 2:
                self.of_bytes[token[0] << 8 | token[1]] = rank
        self.words, self.bare = _Cache(self._word), _Cache(self._piece)
        self.waiting: list[tuple[bytes, bytearray]] = []  # pre-tokens, and where their ids go
        self.composed: list[tuple[bytearray, list[bytearray]]] = []  # the same for words of several

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each pre-token, of 32 bits.

        The queue: ``buckets`` holds the list positions of each rank; a bit of ``bitmap`` says that a
        rank has a bucket, a bit of ``top`` that a word of the bitmap isn't 0. A bucket is emptied from
        left to right. Once a merge makes a pair of a lower rank, what is left of the bucket waits in
        ``rests``, as a heap, and that pair comes first. Positions count a separator after each pre-token.
        """
        rank_of = self.ranks.get
        raw = b"\0".join([*pieces, b""])
        n = len(raw)
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        octets = np.frombuffer(raw, np.uint8).astype(np.uint16)
        first = np.full(n, -1, np.int32)
        first[:-1] = self.of_bytes[octets[:-1] << 8 | octets[1:]]
        first[ends] = first[ends - 1] = -1
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        after[ends] = 0
        before[starts] = -1
        order = np.argsort(first, kind="stable")
        order = order[np.searchsorted(first[order], 0) :]
        found, at = np.unique(first[order], return_index=True)
        order, at = order.tolist(), [*at.tolist(), len(order)]
        buckets: dict[int, list[int]] = {}
        rests: dict[int, list[int]] = {}
        bitmap, top = [0] * (self.size // WORD + 1), 0
        for k, rank in enumerate(found.tolist()):
            buckets[rank] = order[at[k] : at[k + 1]]
            bitmap[rank // WORD] |= BIT[rank % WORD]
            top |= 1 << rank // WORD
        pair, after, before = first.tolist(), after.tolist(), before.tolist()
        token = self.of_byte[octets]
        token[ends] = GONE
        token = token.tolist()
        del octets, first, order
        while top:
            word = (top & -top).bit_length() - 1
            bits = bitmap[word]
            lowest = word * WORD + (bits & -bits).bit_length() - 1
            bitmap[word] = bits = bits & (bits - 1)
            if not bits:
                top &= top - 1
            bucket, rest, lower = buckets.pop(lowest, []), rests.pop(lowest, None), False
            if rest is None:
                bucket.sort()
                positions = iter(bucket)
            else:
                for i in bucket:
                    heappush(rest, i)
                positions = _drained(rest)
            for i in positions:
                if pair[i] != lowest:
                    continue  # stale
                gone = after[i]
                after[i] = end = after[gone]
                before[end] = i
                token[i], token[gone] = lowest, GONE
                pair[gone] = pair[i] = -1
                stop = after[end]
                if stop:
                    rank = rank_of(raw[i:stop])
                    if rank is not None:
                        pair[i] = rank
                        if rank in buckets:
                            buckets[rank].append(i)
                        else:
                            buckets[rank] = [i]
                            word = rank // WORD
                            bitmap[word] |= BIT[rank % WORD]
                            top |= 1 << word
                        lower = rank < lowest
                start = before[i]
                if start >= 0:
                    rank = rank_of(raw[start:end])
                    if rank is None:
                        pair[start] = -1
                    else:
                        pair[start] = rank
                        if rank in buckets:
                            buckets[rank].append(start)
                        else:
                            buckets[rank] = [start]
                            word = rank // WORD
                            bitmap[word] |= BIT[rank % WORD]
                            top |= 1 << word
                        lower = lower or rank < lowest
                if lower:
                    rests[lowest] = list(positions) if rest is None else rest
                    bitmap[lowest // WORD] |= BIT[lowest % WORD]
                    top |= 1 << lowest // WORD
                    break
        tokens = np.array(token, np.int32)
        left = tokens != GONE
        ids, at = tokens[left], (4 * np.cumsum(left)[ends]).tolist()
        if (ids == NONE).any():
            raise KeyError("a byte that the vocabulary has no token of")
        ids = ids.tobytes()
        return [ids[i:j] for i, j in pairwise([0, *at])]

    def _piece(self, piece: str) -> bytearray:
        """The ids of a pre-token, which ``_settle`` fills in unless the vocabulary has it whole."""
        raw = piece.encode()
        whole = self.ranks.get(raw)
        if whole is not None:
            return bytearray(whole.to_bytes(4, byteorder))
        ids = bytearray()
        self.waiting.append((raw, ids))
        return ids

    def _word(self, word: str) -> bytearray:
        """The same of a space and a word, of one pre-token or several."""
        if not BLACK(word):
            raise _NoWord
        first, *others = self.pieces(" " + word)
        if not others:
            return self._piece(first)
        ids = bytearray()
        self.composed.append((ids, [self.words[first[1:]], *map(self.bare.__getitem__, others)]))
        return ids

    def _look_up(self, text: str) -> list[bytearray]:
        if not self.wordwise:
            return list(map(self.bare.__getitem__, self.pieces(text)))
        first, *words = text.split(" ")
        try:
            found = list(map(self.words.__getitem__, words))
        except _NoWord:  # a space before white space or at the end
            first, *words = AT_WORD.split(text)
            found = list(map(self.words.__getitem__, words))
        return [*map(self.bare.__getitem__, self.pieces(first)), *found]

    def _settle(self) -> None:
        """Merges what has been looked up and wasn't remembered."""
        waiting, k = self.waiting, 0
        while k < len(waiting):
            start, size = k, 0
            while k < len(waiting) and (k == start or size + len(waiting[k][0]) <= QUEUE):
                size += len(waiting[k][0])
                k += 1
            for (_, ids), merged in zip(waiting[start:k], self.merge([raw for raw, _ in waiting[start:k]])):
                ids[:] = merged
        waiting.clear()
        for ids, parts in self.composed:
            ids[:] = b"".join(parts)
        self.composed.clear()

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(ids.tolist() for _, ids in self.encode_all([text])))

    def encode_all(self, texts: Iterable[str]) -> Iterator[tuple[int, np.ndarray]]:
        """The place of a text and the ids of a segment of it, in order, of all segments of all texts."""
        group, size = [], 0
        for place, text in enumerate(texts):
            for part in segments(text):
                group.append((place, self._look_up(part)))
                size += len(part)
                if size >= SEGMENT:
                    yield from self._settled(group)
                    group, size = [], 0
        yield from self._settled(group)

    def _settled(self, group: list[tuple[int, list[bytearray]]]) -> Iterator[tuple[int, np.ndarray]]:
        self._settle()
        for place, found in group:
            yield place, np.frombuffer(b"".join(found), np.int32)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))


def _drained(heap: list[int]) -> Iterator[int]:
    while heap:
        yield heappop(heap)


class _NoWord(Exception):
    pass


class _Cache(dict):
    """Two generations: when the young one is full it becomes the old one, so frequent pre-tokens stay."""

    def __init__(self, make):
        self.make, self.old = make, {}

    def __missing__(self, key: str) -> bytearray:
        ids = self.old.get(key)
        if ids is None:
            ids = self.make(key)
        if len(key) <= CACHED_LENGTH:
            if len(self) >= CACHE:
                self.old = dict(self)
                self.clear()
            self[key] = ids
        return ids


def segments(text: str):
    """The text in parts whose matches are the whole text's.

    A part begins at a space between two characters that aren't white space: no match
    crosses such a place from the left, and none that begins there looks to its left.
    """
    start = 0
    while len(text) - start > SEGMENT:
        cut = SAFE.search(text, start + SEGMENT)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


SAFE = regex.compile(r"(?<=\S) (?=\S)")

def tokenizer(path: str, pattern: str) -> ByteBPE:
    """One for each worker process and vocabulary."""
    loaded = remembered("byte_bpe")
    if (path, pattern) not in loaded:
        loaded[path, pattern] = ByteBPE(read_ranks(path), pattern)
    return loaded[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the ids of ``text`` as ``array<int>`` in a column ``ids``; other columns are kept.

    ``path`` must be readable on every executor, as tokenizer files installed there are.
    """
    from pyspark.sql import types as T

    keep = [c for c in docs.columns if c != ids]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(ids, T.ArrayType(T.IntegerType(), False))])

    def run(batches):
        bpe = tokenizer(path, pattern)
        for batch in batches:
            texts = (x.as_py() or "" for x in batch.column(keep.index(text)))
            lists = [
                np.concatenate([ids for _, ids in parts])
                for _, parts in groupby(bpe.encode_all(texts), itemgetter(0))
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(lists, pa.list_(pa.int32()))], names=[*keep, ids]
            )

    return docs.select(*[f"`{c}`" for c in keep]).mapInArrow(run, schema)


def decode(docs: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "bytes") -> DataFrame:
    """``docs`` with the bytes of the id lists in a binary column ``out``; null lists are empty."""
    from pyspark.sql import types as T

    keep = [c for c in docs.columns if c != out]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(out, T.BinaryType())])

    def run(batches):
        bpe = tokenizer(path, pattern)
        for batch in batches:
            raw = [bpe.decode(x.as_py() or []) for x in batch.column(keep.index(ids))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], names=[*keep, out])

    return docs.select(*[f"`{c}`" for c in keep]).mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode every whole text and decode the ids: counts and digests for each row.

    Columns ``doc_id``, ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by commas)
    and ``decoded_sha256``. A null or empty text has 0 ids and the digests of nothing.
    Repeated rows give repeated rows.
    """

    def run(batches):
        bpe = tokenizer(path, pattern)
        for batch in batches:
            counts, of_ids, of_bytes = [], [], []
            texts = (x.as_py() or "" for x in batch.column(1))
            for _, parts in groupby(bpe.encode_all(texts), itemgetter(0)):
                n, ids_digest, bytes_digest = 0, sha256(), sha256()
                for _, ids in parts:
                    if ids := ids.tolist():
                        ids_digest.update(("," if n else "").encode())
                        ids_digest.update(",".join(map(bpe.decimal.__getitem__, ids)).encode())
                        bytes_digest.update(bpe.decode(ids))
                        n += len(ids)
                counts.append(n)
                of_ids.append(ids_digest.hexdigest())
                of_bytes.append(bytes_digest.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_bytes)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
