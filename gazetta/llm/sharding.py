"""Sharding by a permutation-filled lookup table: consistent placement with constant-time lookups."""

from __future__ import annotations

import hashlib
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: A prime well above 100 slots a shard, so that shares differ by about one percent.
TABLE_SIZE, SHARDS = 65_537, 64


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


@lru_cache(16)
def fill_table(shards: int = SHARDS, size: int = TABLE_SIZE) -> tuple[int, ...]:
    """Slot -> shard. Each shard has a permutation of the slots (offset and step modulo a prime); shards take turns, each
    claiming the first slot of its permutation that is still free. Adding a shard moves few slots of the others."""
    if shards < 1 or size <= shards or any(size % k == 0 for k in range(2, int(size**0.5) + 1)):
        raise ValueError("the table size must be a prime larger than the number of shards")
    at = [_number(f"offset {s}") % size for s in range(shards)]
    step = [_number(f"step {s}") % (size - 1) + 1 for s in range(shards)]
    table, claimed = [-1] * size, 0
    while True:
        for s in range(shards):
            while table[at[s]] >= 0:
                at[s] = (at[s] + step[s]) % size
            table[at[s]] = s
            claimed += 1
            if claimed == size:
                return tuple(table)


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """Slot of a key: the first 60 bits of the MD5 of its text, modulo the table size. A null key hashes as no text at all."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint") % size


def assign_shards(df: DataFrame, key: str = "doc_id", shards: int = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """Add ``slot`` and ``shard``. The table has ``size`` rows whatever the input, so it is broadcast; rows do not move.

    Rows with equal keys go to the same shard; null keys share one. Columns already named slot or shard are replaced.
    An empty input gives an empty result.
    """
    table = df.sparkSession.createDataFrame(list(enumerate(fill_table(shards, size))), "slot bigint, shard int")
    return fresh(df, "slot", "shard").withColumn("slot", slot_of(F.col(key), size)).join(F.broadcast(table), "slot")


def write_shards(df: DataFrame, path: str, key: str = "doc_id", shards: int = SHARDS) -> None:
    """Write one folder a shard. Tasks write their own rows, so a shard with many rows is written by many tasks."""
    assign_shards(df, key, shards).write.partitionBy("shard").parquet(path)
