"""Sharding (5): permutation-filled lookup table, DataFrame functions only.

Every shard has its own preference order of the slots of a prime-sized table
(offset + i * skip mod size: a permutation, as the size is prime).  Shards take
turns claiming their next free slot until the table is full, so slot counts
differ by one at most, and taking a shard away moves few other slots.  The
table has `size` entries, a parameter that does not grow with the data; it is
broadcast, and a document is placed by one lookup of its hash.

Cases: a null doc_id is placed like an empty key; repeated rows go together;
an empty table gives no rows; other columns pass through (a column called
`shard` is replaced).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

N_SHARDS = 64
TABLE_SIZE = 8191


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """Index of the shard that owns each slot; a pure function of its arguments."""
    if not shards or size < len(shards):
        raise ValueError("the table needs at least one slot a shard")
    if size < 2 or any(size % p == 0 for p in range(2, int(size ** 0.5) + 1)):
        raise ValueError("the table size must be a prime")
    place = [_number(f"offset/{s}") % size for s in shards]
    skip = [_number(f"skip/{s}") % (size - 1) + 1 for s in shards]
    table = [-1] * size
    for turn in range(size):
        k = turn % len(shards)
        while table[place[k]] >= 0:
            place[k] = (place[k] + skip[k]) % size
        table[place[k]] = k
    return table


def lookup_frame(spark: SparkSession, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """(slot, shard) with one row per slot, made by a projection of a literal."""
    flat = F.split(F.lit(",".join(map(str, fill_table(shards, size)))), ",")
    return spark.range(1).select(F.posexplode(flat).alias("slot", "shard")).select(
        "slot", F.col("shard").cast("int").alias("shard"))


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """Slot of a key: 60 bits of its MD5, modulo the table size."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(size)).cast("int")


def shard_names(n: int = N_SHARDS) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def assign_shards(docs: DataFrame, key: str = "doc_id", shards: list[str] | None = None,
                  size: int = TABLE_SIZE) -> DataFrame:
    """Operator 5: `docs` with the column `shard`."""
    table = lookup_frame(docs.sparkSession, shards or shard_names(), size)
    d = docs.drop("shard").withColumn("_slot", slot_of(F.col(key), size))
    return d.join(F.broadcast(table), F.col("_slot") == F.col("slot")).drop("_slot", "slot")


def write_shards(docs: DataFrame, path: str, files_per_shard: int = 4, **kw) -> None:
    """One folder a shard, several files each so that no task writes a whole shard."""
    out = assign_shards(docs, **kw)
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(files_per_shard))
    out.repartition("shard", salt).write.partitionBy("shard").parquet(path)
