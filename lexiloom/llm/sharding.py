"""Sharding by a permutation-filled lookup table.

Every shard has a permutation of the slots of a prime-sized table, its order of
preference, from two hashes of its name. Shards take turns, each claiming the
first slot of its order that is free, until the table is full: all shards then
own equally many slots, but for one, and a shard that comes or goes moves few
other slots. A row's slot is a hash of its key; the table is broadcast, so
placement takes constant time and no shuffle. Its size is a parameter and does
not grow with the data.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 65537
SHARDS = 64


def _prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def preference(name: str, slots: int) -> tuple[int, int]:
    """Offset and skip of a shard's permutation: slot j of it is (offset + j * skip) mod slots."""
    digest = hashlib.sha256(name.encode()).digest()
    return int.from_bytes(digest[:8], "big") % slots, int.from_bytes(digest[8:16], "big") % (slots - 1) + 1


def fill(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The number of the shard that owns each slot."""
    if not _prime(slots) or not 0 < len(shards) <= slots or len(set(shards)) != len(shards):
        raise ValueError("the table needs a prime size, and distinct shards, no more than slots")
    at = [preference(s, slots) for s in shards]
    owner, left = [-1] * slots, slots
    while left:
        for i, (slot, skip) in enumerate(at):
            while owner[slot] >= 0:
                slot = (slot + skip) % slots
            owner[slot] = i
            at[i] = (slot + skip) % slots, skip
            left -= 1
            if not left:
                break
    return owner


def lookup(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """(slot, shard) as a table, read out of one binary literal by position."""
    packed = F.lit(b"".join(i.to_bytes(4, "big") for i in fill(shards, slots)))
    owner = F.conv(F.hex(F.substring(F.lit(packed), (F.col("id") * 4 + 1).cast("int"), F.lit(4))), 16, 10).cast("int")
    return spark.range(slots).select(F.col("id").alias("slot"), owner.alias("shard"))


def slot_of(key: str | Column, slots: int = SLOTS) -> Column:
    """A key's slot: the first 60 bits of the MD5 of its text, modulo the table's size."""
    text = F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(slots))


def place(df: DataFrame, key: str = "doc_id", shards: int | list[str] = SHARDS, slots: int = SLOTS, keep: tuple[str, ...] | None = None) -> DataFrame:
    """``keep`` (by default the key) with slot and shard of every row.

    A null key is placed as the empty text. Equal keys share a slot, repeated
    rows stay, an empty table gives an empty result, and other columns of the
    table, whatever their names, are not read.
    """
    names = [f"shard-{i}" for i in range(shards)] if isinstance(shards, int) else shards
    kept = keep or (key,)
    rows = df.select(*[F.col(k).alias(f"__keep{i}") for i, k in enumerate(kept)], slot_of(key, slots).alias("slot"))
    placed = rows.join(F.broadcast(lookup(df.sparkSession, names, slots)), "slot")
    return placed.select(*[F.col(f"__keep{i}").alias(k) for i, k in enumerate(kept)], "slot", "shard")
