"""64-bit hashes of words and word runs as numpy arrays."""

from __future__ import annotations

import numpy as np
import xxhash

from strata.llm.common import remembered

#: Words remembered by a worker.
CACHE = 400_000
#: An odd multiplier: (2**64 / golden ratio), odd.
STEP = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """XXH64 of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def word_hashes(words: list[bytes]) -> np.ndarray:
    own = remembered("words")
    known = own.get("hashes")
    if known is None:
        known = own["hashes"] = WordHashes()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words, from the words' hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for i in range(1, k):
        out = out * STEP + h[i : n + i]
    return mixed(out + np.uint64(k))
