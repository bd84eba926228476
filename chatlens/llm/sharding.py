"""Placement of rows on shards by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a table of prime size
(an offset and a step from hashes of its name). The shards take turns; at its
turn a shard claims the first slot of its permutation that is still free.
Each shard so holds an equal part of the slots (one more or less), and adding
or removing a shard moves little beyond its own part. A row is placed by its
key: hash modulo the table's size, then one look-up in the broadcast table,
whose size is a parameter and does not grow with the data.

Rows with equal keys share a shard. A null key is replaced by a hash of the
other key text, so that many null ids do not pile up on one shard.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlens.llm.common import free_name

SLOTS = 65537           # a prime, over a hundred times the number of shards
SHARDS = tuple(f"shard-{k:02d}" for k in range(64))


def _hash(name: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}:{name}".encode()).hexdigest()[:15], 16)


def fill_table(shards=SHARDS, slots: int = SLOTS) -> list[int]:
    """Index of the shard that holds each slot."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shard names must be given and differ")
    if slots < len(shards) or any(slots % d == 0 for d in range(2, int(slots ** 0.5) + 1)):
        raise ValueError("the number of slots must be a prime of at least the number of shards")
    at = [_hash(s, "offset") % slots for s in shards]
    step = [_hash(s, "step") % (slots - 1) + 1 for s in shards]
    held = [-1] * slots
    free = slots
    while free:
        for k in range(len(shards)):
            while held[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % slots
            held[at[k]] = k
            free -= 1
            if not free:
                break
    return held


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key: 60 bits of its MD5 modulo the table's size."""
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long") % F.lit(slots)


def place(df: DataFrame, key_col: str = "doc_id", spare_col: str | None = "text", shards=SHARDS,
          slots: int = SLOTS, slot_name: str = "slot", shard_name: str = "shard") -> DataFrame:
    """``df`` with its slot and shard (under free names, if those are taken).
    Null keys use ``spare_col``; if that is null too, the empty string."""
    slot_name = free_name(df, slot_name)
    shard_name = free_name(df, shard_name)
    key = F.col(f"`{key_col}`").cast("string")
    if spare_col:
        key = F.coalesce(key, F.md5(F.col(f"`{spare_col}`").cast("string")))
    # one literal that Spark unfolds: a plan with a row for each slot is costly
    held = F.posexplode(F.split(F.lit(",".join(map(str, fill_table(shards, slots)))), ","))
    lookup = df.sparkSession.range(1).select(held.alias("_at", "_shard")).select(
        F.col("_at").cast("long").alias(slot_name),
        F.element_at(F.array(*[F.lit(s) for s in shards]), F.col("_shard").cast("int") + 1).alias(shard_name))
    out = df.withColumn(slot_name, slot_of(F.coalesce(key, F.lit("")), slots))
    return (out.join(F.broadcast(lookup), slot_name)
            .select(*[F.col(f"`{c}`") for c in df.columns], slot_name, shard_name))
