"""Sharding with a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime size (an offset and a step,
both hashed from its name). The shards take turns, each claiming its next free slot, until the table is
full. The table is a few hundred KB whatever the data's size; it is broadcast, and a document is placed by
one hash and one lookup. When a shard goes, few slots of the others move.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.session import read_table

#: Prime; over 100 slots for each of up to 650 shards keep the shares within about 1 %.
TABLE_SIZE = 65_537
SHARDS = 64


def _hash(name: str, salt: str, below: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{salt}:{name}".encode(), digest_size=8).digest(), "big") % below


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """For each slot the index of the shard that claims it.

    No shards, more shards than slots, equal names or a size that is not prime are errors.
    """
    if not _is_prime(size) or not 0 < len(shards) <= size or len(set(shards)) < len(shards):
        raise ValueError("needs a prime size, and distinct shards, at least one and no more than the size")
    places = [_hash(s, "offset", size) for s in shards]
    steps = [_hash(s, "step", size - 1) + 1 for s in shards] if size > 2 else [1] * len(shards)
    table = [-1] * size
    free = size
    while free:
        for k, step in enumerate(steps):
            at = places[k]
            while table[at] >= 0:
                at = (at + step) % size
            table[at] = k
            places[k] = (at + step) % size
            free -= 1
            if not free:
                break
    return table


def _fresh(docs: DataFrame, name: str) -> str:
    """A column name that the table hasn't."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def place(docs: DataFrame, shards: list[str], key: str = "doc_id", size: int = TABLE_SIZE) -> DataFrame:
    """docs with two more columns, slot (int) and shard (string); columns of these names are replaced.

    A null key has a place too (the slot that its hash names); equal keys share a place; an empty table
    stays empty.
    """
    spark = docs.sparkSession
    table, at = fill_table(shards, size), _fresh(docs, "_slot")
    lookup = spark.createDataFrame([(i, shards[k]) for i, k in enumerate(table)], f"{at} int, shard string")
    kept = [c for c in docs.columns if c.lower() not in ("slot", "shard")]
    slotted = docs.withColumn(at, F.pmod(F.xxhash64(F.col(key)), F.lit(size)).cast("int"))
    # bounded: the lookup has `size` rows, a parameter that does not depend on the documents
    return slotted.join(F.broadcast(lookup), at).select(*[F.col(f"`{c}`") for c in kept], F.col(at).alias("slot"), "shard")


def write_shards(docs: DataFrame, path: str, shards: list[str], key: str = "doc_id", files: int = 4) -> None:
    """Write docs as Parquet, a folder for each shard, each shard's rows dealt over so many files: a key that
    holds much of the rows fills its shard's files evenly instead of one task."""
    part = _fresh(docs, "_part")
    placed = place(docs, shards, key).withColumn(part, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]), F.lit(files)))
    placed.repartition("shard", part).drop(part).write.partitionBy("shard").parquet(path)


def names(n: int = SHARDS) -> list[str]:
    return [f"shard-{k:05d}" for k in range(n)]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(read_table(spark, sf_dir, "documents").select("doc_id"), names())
