"""Placing rows on shards by a permutation-filled lookup table.

Every shard's name gives it a preference order over the slots of a table of prime size. Shards take turns, each
claiming the first slot of its order that is still free, until the table is full. A row's key is hashed to a slot, and
the slot names the shard. Shards hold equally many slots to within one, and a shard that leaves or joins moves few
slots besides its own. The table's size is a parameter and has nothing to do with the data, so it is broadcast.

Defined results: a NULL key is placed like the empty string. Equal keys are placed on the same shard. Extra columns,
also ones called ``slot`` or ``shard``, are not touched: the result has the key, ``slot`` and ``shard`` only. No shards
or a table size that is not a prime above their number raise an error.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import md5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def preference(name: str, size: int) -> tuple[int, int]:
    """(first slot, step) of a shard's order; any step below a prime size visits every slot."""
    digits = md5(name.encode()).hexdigest()
    return int(digits[:15], 16) % size, int(digits[15:30], 16) % (size - 1) + 1


def lookup_table(shards: Sequence[str], size: int) -> list[int]:
    """The number of the shard that holds each slot."""
    if not shards or size <= len(shards) or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("needs shards, and a prime number of slots above theirs")
    owner = [-1] * size
    orders = [preference(name, size) for name in shards]
    tried = [0] * len(shards)
    for claim in range(size):
        shard = claim % len(shards)
        first, step = orders[shard]
        while owner[slot := (first + tried[shard] * step) % size] >= 0:
            tried[shard] += 1
        owner[slot] = shard
    return owner


def slot_of(key: Column, size: int) -> Column:
    """The slot of a key: its digest's first 60 bits, modulo the table's size."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(size)).cast("int")


def slots(spark: SparkSession, shards: Sequence[str], size: int) -> DataFrame:
    """(slot, shard), one row a slot."""
    listed = F.split(F.lit(",".join(map(str, lookup_table(shards, size)))), ",")
    named = F.array(*map(F.lit, shards))
    rows = spark.range(1).select(F.posexplode(listed).alias("slot", "number"))
    return rows.select("slot", F.get(named, F.col("number").cast("int")).alias("shard"))


def place(rows: DataFrame, key: str, shards: Sequence[str], size: int = 6553) -> DataFrame:
    """(key, slot, shard) for every row."""
    table = F.broadcast(slots(rows.sparkSession, shards, size))  # `size` rows
    return rows.select(key, slot_of(F.col(key), size).alias("slot")).join(table, "slot").select(key, "slot", "shard")
