"""Placement of keys on shards through a permutation-filled lookup table.

Every shard has its own preference order over the slots of a table of prime size (a start and a
stride from its name's hash). Shards take turns, each claiming the first free slot of its order, until the
table is full, so that all shards get the same number of slots but one, and few slots change owner when
a shard comes or goes. A key's slot is its hash modulo the size. The table has ``size`` rows whatever
the data, is built once on the driver and broadcast; placing a row is a hash, a remainder and one probe.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prime, 128 slots a shard, so that shares differ by less than 1 %.
SIZE, SHARDS = 2053, tuple(f"shard-{i:02d}" for i in range(16))


def preferences(name: str, size: int) -> tuple[int, int]:
    """First slot and stride of a shard's order: both from the MD5 of its name."""
    d = hashlib.md5(name.encode()).hexdigest()
    return int(d[:8], 16) % size, int(d[8:16], 16) % (size - 1) + 1


def fill(shards: tuple[str, ...], size: int) -> list[int]:
    """Owner (index into ``shards``) of each slot."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards must be named, each once")
    if size < max(2, len(shards)) or any(size % k == 0 for k in range(2, int(size**0.5) + 1)):
        raise ValueError("size must be a prime, and at least the number of shards")
    orders = [preferences(s, size) for s in shards]
    step, owner, taken = [0] * len(shards), [-1] * size, 0
    while True:
        for i, (start, stride) in enumerate(orders):
            while owner[slot := (start + step[i] * stride) % size] >= 0:
                step[i] += 1
            owner[slot] = i
            taken += 1
            if taken == size:
                return owner


def lookup_table(spark: SparkSession, shards: tuple[str, ...] = SHARDS, size: int = SIZE) -> DataFrame:
    """(slot long, shard string), ``size`` rows, as one literal that needs no Python when it is read."""
    names = F.array(*map(F.lit, shards))
    listed = F.split(F.lit(",".join(map(str, fill(tuple(shards), size)))), ",")
    return spark.range(1).select(F.posexplode(listed).alias("slot", "owner")).select(F.col("slot").cast("long").alias("slot"), F.element_at(names, F.col("owner").cast("int") + 1).alias("shard"))


def place(df: DataFrame, key: str, shards: tuple[str, ...] = SHARDS, size: int = SIZE) -> DataFrame:
    """``df`` with ``slot`` and ``shard`` added (columns of these names are replaced).

    The slot is the first 32 bits of the MD5 of the key as text, modulo ``size``; a null key counts as the empty text. Repeated keys go
    to one shard by definition; rows are neither moved nor dropped, and an empty table stays empty.
    """
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    named = df.drop("slot", "shard").withColumn("slot", F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % size)
    return named.join(F.broadcast(lookup_table(df.sparkSession, shards, size)), "slot", "left").select(*[c for c in named.columns if c != "slot"], "slot", "shard")
