"""Tables kept in hash buckets of their key, so that what is merged into them or looked up in them is moved, not they.

A table's versions are tables <name>__v<n> in the session's catalog, each bucketed alike. An upsert writes the next one: the
old version's buckets are read where they lie, only the new rows are shuffled, and each task writes its own bucket. A version
counts once it is in the catalog, so a write that fails leaves the newest one as it was. A table has one writer at a time.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def versions(spark: SparkSession, name: str) -> list[int]:
    found = (re.fullmatch(rf"{re.escape(name.lower())}__v([0-9]+)", t.name.lower()) for t in spark.catalog.listTables())
    return sorted(int(m[1]) for m in found if m)


def read(spark: SparkSession, name: str) -> DataFrame:
    """The newest version."""
    return spark.table(f"{name}__v{versions(spark, name)[-1]}")


def _save(df: DataFrame, name: str, number: int, key: str, buckets: int, path: str) -> None:
    # another folder for each attempt: what a failed one has left isn't in the way
    df.write.bucketBy(buckets, key).sortBy(key).option("path", f"{path}/v={number}-{uuid.uuid4().hex[:8]}").saveAsTable(f"{name}__v{number}")


def create(df: DataFrame, name: str, key: str, buckets: int, path: str) -> None:
    """Write the first version, under a folder that all executors share; the only time that the table is shuffled."""
    if versions(df.sparkSession, name):
        raise ValueError(f"{name} is there already")
    _save(df.repartition(buckets, key), name, 0, key, buckets, path)


def change(spark: SparkSession, name: str, key: str, buckets: int, path: str, merge: Callable[[DataFrame], DataFrame], keep: int = 2) -> None:
    """Write merge(newest version) as the next one; merge joins on the key and keeps the rows of a bucket together. The
    `keep` newest versions stay in the catalog, for readers that have begun."""
    before = versions(spark, name)
    _save(merge(read(spark, name)), name, before[-1] + 1, key, buckets, path)
    for n in before[: -(keep - 1) or None]:
        spark.sql(f"DROP TABLE IF EXISTS {name}__v{n}")
