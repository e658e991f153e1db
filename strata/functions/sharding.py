"""Shards: the leading bits of a segment's UUID."""

from __future__ import annotations

import random
import uuid
from dataclasses import dataclass
from hashlib import blake2b

from pyspark.sql import Column
from pyspark.sql import functions as F


def shard_of(segment_id: str | uuid.UUID, n_log: int) -> int:
    return uuid.UUID(str(segment_id)).int >> (128 - n_log)


def shard_column(segment_id: Column, n_log: int) -> Column:
    """The shard of UUID texts, for up to 16 bits."""
    lead = F.conv(F.substring(F.regexp_replace(segment_id, "-", ""), 1, 4), 16, 10).cast("int")
    return F.shiftright(lead, 16 - n_log)


@dataclass(frozen=True)
class Shard:
    """Shard ``number`` of ``2 ** n_log``; a table's partition uses ``2 ** (n_log - spread)`` of them."""

    n_log: int = 0
    number: int = 0

    def contains(self, segment_id: str) -> bool:
        return shard_of(segment_id, self.n_log) == self.number

    def children(self) -> tuple[Shard, Shard]:
        return Shard(self.n_log + 1, 2 * self.number), Shard(self.n_log + 1, 2 * self.number + 1)

    def parent(self) -> Shard | None:
        return Shard(self.n_log - 1, self.number // 2) if self.n_log else None

    def new_segment_id(self) -> str:
        if not self.n_log:
            return str(uuid.uuid4())
        rest = uuid.uuid4().int & ((1 << (128 - self.n_log)) - 1)
        return str(uuid.UUID(int=self.number << (128 - self.n_log) | rest))


def choose(partition: str, n_log: int, spread: int = 0, rng: random.Random | None = None) -> Shard:
    """A shard for a write: the partition's own by a stable hash, plus a random step within its share."""
    size = 1 << n_log
    base = int.from_bytes(blake2b(partition.encode(), digest_size=8).digest(), "big") % size
    step = (rng or random).randrange(1 << max(0, n_log - spread)) if n_log else 0
    return Shard(n_log, (base + step) % size)
