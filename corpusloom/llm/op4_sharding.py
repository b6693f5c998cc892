"""Sharding by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table (start and stride hashed
from the shard's name). Shards take turns and each claims the first free slot of its permutation,
so their slot counts differ by one at most, and adding or removing a shard moves few slots. The
table depends on parameters only; it has exactly ``slots`` rows and is broadcast, and each row is
placed by one hash and one lookup.

Rows: every row gets a shard, equal keys the same one; null keys share one slot; other columns stay
as they are. Where the table has a column named slot or shard, the new one has an underscore more
(free_name).
"""

from __future__ import annotations

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, table

SHARDS, SLOTS = 64, 16381


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(names: list[str], slots: int = SLOTS) -> list[int]:
    """The shard number of each slot."""
    if not names or len(set(names)) != len(names):
        raise ValueError("shard names must be distinct and not empty")
    if not is_prime(slots) or slots < len(names):
        raise ValueError("slots must be a prime of at least the number of shards")
    start = [xxhash.xxh64_intdigest(n.encode(), seed=1) % slots for n in names]
    stride = [xxhash.xxh64_intdigest(n.encode(), seed=2) % (slots - 1) + 1 if slots > 2 else 1 for n in names]
    owner = [-1] * slots
    free = slots
    while free:
        for s in range(len(names)):
            while owner[start[s]] >= 0:
                start[s] = (start[s] + stride[s]) % slots
            owner[start[s]] = s
            free -= 1
            if not free:
                break
    return owner


def with_shard(docs: DataFrame, key: str = "doc_id", shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """docs with two more columns, slot and shard (int), under names that docs does not use."""
    owner = lookup_table([f"shard-{i:05d}" for i in range(shards)], slots)
    probe, slot, shard = (free_name(docs, c) for c in ("probe", "slot", "shard"))
    placed = docs.sparkSession.createDataFrame([(i, i, s) for i, s in enumerate(owner)], f"`{probe}` int, `{slot}` int, `{shard}` int")
    keyed = docs.withColumn(probe, F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(slots)).cast("int"))
    return keyed.join(F.broadcast(placed), probe).drop(probe)  # slots rows, whatever the data


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", shards: int = SHARDS, splits: int = 4) -> None:
    """One folder of Parquet files for each shard; a shard's rows are dealt to ``splits`` tasks."""
    salt = free_name(docs, "salt")
    dealt = with_shard(docs, key, shards).withColumn(salt, F.pmod(F.hash(*docs.columns), F.lit(splits)))
    slot, shard = free_name(docs, "slot"), free_name(docs, "shard")
    dealt.repartition(shards * splits, shard, salt).drop(salt, slot).write.partitionBy(shard).parquet(path)


def op4_shard_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_shard(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")).select("doc_id", "slot", "shard")
