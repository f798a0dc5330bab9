"""Sharding by a permutation-filled lookup table.

Every shard has its own preference order of all slots of a table whose size is
a prime: it starts at an offset and walks by a step, both hashed from its name.
The shards take turns; each claims the first slot of its order that is still
free, until the table is full. A row's key is hashed to a slot and the slot
names the shard: one broadcast equi-join, constant time for a row. When shards
come or go, most slots keep their owner.

The table has `size` rows, a parameter with a checked bound, so it may be
filled on the driver and broadcast whatever the data's size. Rows are placed
by DataFrame functions alone, without a shuffle, and a hot source or a hot
text cannot unbalance the shards because the key is the document's id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A prime; 128 slots for each of 64 shards keep shard sizes within about one hundredth.
TABLE_SIZE = 8191
MAX_TABLE = 1 << 20
NULL_KEY = "~null~"


def preference(name: str, size: int) -> tuple[int, int]:
    """(offset, step) of a shard's slot order: two parts of the MD5 of its name."""
    digest = hashlib.md5(name.encode()).hexdigest()
    return int(digest[:15], 16) % size, int(digest[15:30], 16) % (size - 1) + 1


def fill_table(shards: Sequence[str], size: int = TABLE_SIZE) -> list[int]:
    """Slot -> index of the owning shard. ValueError unless size is a prime within MAX_TABLE and no shard is named twice."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct and at least one")
    if not max(3, len(shards)) <= size <= MAX_TABLE or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError(f"size must be a prime from the number of shards to {MAX_TABLE}")
    orders = [preference(s, size) for s in shards]
    at, owner, left = [o for o, _ in orders], [-1] * size, size
    while True:
        for i, (_, step) in enumerate(orders):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + step) % size
            owner[at[i]] = i
            left -= 1
            if not left:
                return owner


def lookup(spark: SparkSession, shards: Sequence[str], size: int = TABLE_SIZE) -> DataFrame:
    """The filled table as (slot int, shard string)."""
    names = F.array(*[F.lit(s) for s in shards])
    owners = F.split(F.lit(",".join(map(str, fill_table(shards, size)))), ",")
    return spark.range(1).select(F.posexplode(owners).alias("slot", "owner")).select("slot", F.element_at(names, F.col("owner").cast("int") + 1).alias("shard"))


def slot_of(keys: Sequence[Column], size: int) -> Column:
    """Slot of a key: 60 bits of the MD5 of its text, modulo size. Nulls count as the text NULL_KEY."""
    text = F.concat_ws("\x1f", *[F.coalesce(k.cast("string"), F.lit(NULL_KEY)) for k in keys])
    return (F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % size).cast("int")


def assign_shards(df: DataFrame, keys: Sequence[str], shards: Sequence[str], size: int = TABLE_SIZE) -> DataFrame:
    """Key columns of every row of df plus slot int and shard string.

    Rows stay rows: equal keys, and null keys, go to one shard together; an
    empty table gives no rows. Other columns of df are left out, so clashing
    names do not matter (a key named slot or shard is a ValueError).
    """
    if {"slot", "shard"} & {k.lower() for k in keys}:
        raise ValueError("a key may not be named slot or shard")
    placed = df.select(*keys).withColumn("slot", slot_of([F.col(k) for k in keys], size))
    return placed.join(F.broadcast(lookup(df.sparkSession, shards, size)), "slot", "left").select(*keys, "slot", "shard")
