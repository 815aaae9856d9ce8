"""Sharding by a permutation-filled lookup table.

Every shard has its own preference order over the slots of a table of prime size (an offset
and a step taken from the hash of its name). The shards take turns; each claims the first
slot of its order that is still free, until the table is full. So the shards' slot counts
differ by one at most, and adding or removing a shard moves few slots besides its own.

The table has a fixed size, whatever the data: it is broadcast, and each key finds its
shard by one hash and one lookup, without a shuffle and independent of how often a key
occurs.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quayside.llm.common import documents

SLOTS = 65_537  # prime


def _hash(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{salt}:{name}".encode()).digest()[:8], "big")


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """Shard index of every slot. ``slots`` must be a prime above the number of shards, so
    that every step reaches all slots; names must differ."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be given and differ")
    if slots <= len(shards) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be a prime above the number of shards")
    at = [_hash(s, "offset") % slots for s in shards]
    step = [_hash(s, "step") % (slots - 1) + 1 for s in shards]
    table, left = [-1] * slots, slots
    while True:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % slots
            table[at[i]] = i
            left -= 1
            if not left:
                return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key: 60 bits of its MD5 (as text), modulo the table size; null keys take the
    slot of the empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def assign_shards(df: DataFrame, key: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """``df`` with ``slot`` (int) and ``shard`` (name) per row; columns of these names are
    replaced. Rows with one key share a shard; null keys and repeated rows are placed like
    any; an empty table stays empty."""
    spark = df.sparkSession
    table = lookup_table(shards, slots)
    entries = spark.createDataFrame([(i, shards[s]) for i, s in enumerate(table)], "slot int, shard string")
    src = df.drop("slot", "shard").withColumn("slot", slot_of(F.col(f"`{key}`"), slots))
    return src.join(F.broadcast(entries), "slot")  # `slots` rows, a fixed number


def shard_names(n: int) -> list[str]:
    return [f"shard-{i:04d}" for i in range(n)]


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 64: doc_id, slot, shard."""
    return assign_shards(documents(spark, sf_dir).select("doc_id"), "doc_id", shard_names(64)).select("doc_id", "slot", "shard")
