"""Sharding through a permutation-filled lookup table."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

TABLE_SIZE = 65_537
SHARDS = 256


def _number(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{salt}:{name}".encode()).digest()[:8], "big")


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def fill_table(shards: list[str], size: int = TABLE_SIZE) -> np.ndarray:
    """For each slot the position of its shard in ``shards``.

    A shard prefers the slots ``offset, offset + skip, offset + 2 skip, ...``
    modulo the prime ``size``, which is a permutation of all slots.  The shards
    take turns, each claiming the first slot it likes that is still free, so
    their shares differ by one slot at most and few slots move when the list
    changes.  Names decide, not their order: turns go by name.
    """
    if not _is_prime(size):
        raise ValueError(f"the table size must be prime: {size}")
    if not shards or len(set(shards)) != len(shards) or len(shards) > size:
        raise ValueError("name between one shard and as many as there are slots, each once")
    turns = sorted(range(len(shards)), key=lambda i: shards[i])
    slot = [_number(s, "offset") % size for s in shards]
    skip = [_number(s, "skip") % (size - 1) + 1 for s in shards]
    table = np.full(size, -1, dtype=np.int32)
    left = size
    while True:
        for i in turns:
            while table[slot[i]] >= 0:
                slot[i] = (slot[i] + skip[i]) % size
            table[slot[i]] = i
            left -= 1
            if not left:
                return table


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """The slot of a key, from the first 60 bits of its md5, so that other systems can compute it too."""
    text = F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit("null"))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(size)).cast("int")


def place(df: DataFrame, key: Column, shards: list[str], size: int = TABLE_SIZE,
          slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """Adds slot and shard; the table has ``size`` rows whatever the data, so it is broadcast.

    No shuffle of the data and no state: a lost task computes the same places
    again.  Equal keys (repeated rows too) share a shard; a null key is a key of
    its own.  Use a key as fine as a document id: a coarse one (a source) would
    put a third of all rows in one shard.  Columns of ``df`` named like the two
    that are added are replaced.
    """
    spark = df.sparkSession
    names = np.array(shards, dtype=object)[fill_table(shards, size)]
    table = _table(spark, names, slot_col, shard_col)
    rows = df.drop(shard_col).withColumn(slot_col, slot_of(key, size))
    return rows.join(F.broadcast(table), slot_col)


def _table(spark: SparkSession, names: np.ndarray, slot_col: str, shard_col: str) -> DataFrame:
    """Slots and shard names; each shard's slots travel as one short list."""
    kept = {name: np.flatnonzero(names == name).tolist() for name in dict.fromkeys(names)}
    rows = spark.createDataFrame(list(kept.items()), "name string, slots array<int>")
    return rows.select(F.explode("slots").alias(slot_col), F.col("name").alias(shard_col))


def write_shards(df: DataFrame, path: str, shard_col: str = "shard", parts: int = 1, key: Column | None = None) -> None:
    """One folder per shard; ``parts`` files in each, so that a shard may be larger than a task."""
    salt = F.pmod(F.xxhash64(key) if key is not None else F.monotonically_increasing_id(), F.lit(parts))
    df.repartition(F.col(shard_col), salt).write.partitionBy(shard_col).parquet(path)


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]
