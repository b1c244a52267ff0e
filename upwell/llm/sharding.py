"""Placement of documents by a lookup table that shards fill in turns.

Every shard has its own order of the slots of a prime-sized table, start + k * step;
shards take turns to claim their next free slot. Placement is then one array access.
When a shard leaves, only few slots of the others change hands.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def preference(shard: str, size: int) -> tuple[int, int]:
    """Start and step of a shard's order of slots."""
    word = hashlib.sha256(shard.encode()).digest()
    return int.from_bytes(word[:8], "big") % size, int.from_bytes(word[8:16], "big") % (size - 1) + 1


def fill_table(shards: list[str], size: int) -> list[int]:
    """For each slot the position of its shard in ``shards``.

    ``size`` is prime, so each order visits every slot, and at least the number of shards.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct and at least one")
    if not is_prime(size) or size < len(shards):
        raise ValueError("the table size must be a prime of at least the number of shards")
    owner = [-1] * size
    orders = [preference(s, size) for s in shards]
    at = [0] * len(shards)
    free = size
    while free:
        for i, (start, step) in enumerate(orders):
            while owner[(start + at[i] * step) % size] >= 0:
                at[i] += 1
            owner[(start + at[i] * step) % size] = i
            free -= 1
            if not free:
                break
    return owner


def slot_of(key: Column, size: int) -> Column:
    """The slot of a key: 60 bits of its MD5, modulo the table size."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(size))


def place(docs: DataFrame, shards: list[str], size: int, key: str = "doc_id") -> DataFrame:
    """``docs`` with ``slot`` (long) and ``shard`` (string) by its ``key`` column.

    The table has ``size`` entries whatever the input, and goes to the executors as one
    constant array. A null key has the slot of the empty string. Equal keys, as repeated
    rows, go to the same shard; existing columns of these names are replaced.
    """
    table = F.split(F.lit(",".join(shards[i] for i in fill_table(shards, size))), ",")
    slot = slot_of(F.coalesce(F.col(key).cast("string"), F.lit("")), size)
    return docs.withColumn("slot", slot).withColumn("shard", F.get(table, F.col("slot").cast("int")))
