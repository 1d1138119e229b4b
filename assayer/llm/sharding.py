"""Sharding: a lookup table of prime size that shards fill in turns.

Each shard has a preference order over the slots, a permutation given by an
offset and a step. In turns, each claims the first slot of its order that is
still free, until none is left; so shares differ by one slot at most, and a
change of the shard list moves few slots. A key's slot is its hash modulo the
table's size; the table (`slots` rows, whatever the data) is broadcast.

Defined results: a null key counts as the empty string. Each row is placed;
repeated rows and ties go to one shard. Extra columns are kept by `place`,
unless they are named slot or shard: those are replaced. An empty table gives
no rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 65_537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))
MOST_SLOTS = 1_000_003  # bound of what is broadcast: 16 MB


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % i for i in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """For each slot the number of its shard."""
    if not _is_prime(slots) or not 0 < len(shards) <= slots <= MOST_SLOTS:
        raise ValueError(f"slots must be a prime from the number of shards to {MOST_SLOTS}")
    if len(set(shards)) < len(shards):
        raise ValueError("shard names must differ")
    orders = []
    for name in shards:
        digest = hashlib.sha256(name.encode()).digest()
        orders.append((int.from_bytes(digest[:8], "big") % slots, int.from_bytes(digest[8:16], "big") % max(1, slots - 1) + 1))
    table, asked, claimed = [-1] * slots, [0] * len(shards), 0
    while True:
        for i, (offset, step) in enumerate(orders):
            while table[slot := (offset + asked[i] * step) % slots] >= 0:
                asked[i] += 1
            table[slot] = i
            asked[i] += 1
            claimed += 1
            if claimed == slots:
                return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The first 12 hex digits of the key's MD5, modulo the table's size."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("long") % slots


def place(df: DataFrame, key: str = "doc_id", shards: list[str] | tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """df with its slot and the name of its shard; columns of these names are replaced, the key among them."""
    table = lookup_table(list(shards), slots)
    spark = df.sparkSession
    rows = spark.createDataFrame([(i, shards[x]) for i, x in enumerate(table)], "slot long, shard string")
    kept = [F.col(f"`{c}`") for c in df.columns if c not in ("slot", "shard")]
    return df.select(*kept, slot_of(F.col(f"`{key}`"), slots).alias("slot")).join(F.broadcast(rows), "slot")


def write(df: DataFrame, path: str, key: str = "doc_id", shards: list[str] | tuple[str, ...] = SHARDS, slots: int = SLOTS, files_per_shard: int = 4) -> None:
    """One folder for each shard. A shard's rows go to several tasks, by a second hash."""
    part = "_part"
    while part in df.columns:
        part = f"_{part}"
    placed = place(df.withColumn(part, F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(files_per_shard))), key, shards, slots)
    placed.repartition(len(shards) * files_per_shard, "shard", part).drop(part).write.partitionBy("shard").mode("overwrite").parquet(path)


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    return place(docs).select("doc_id", "slot", "shard")
