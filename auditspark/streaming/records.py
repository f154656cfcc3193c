"""Incremental merging of record logs: new files arrive, a success beats a failure, counts are kept.

The compacted log (an outcome's count and first place for each key) is the keyed state of a streaming aggregation, so Spark's
state store holds it and saves what a batch changes. The outcomes that a batch has changed, with their totals so far, are
written as version v=<batch>; what a batch writes follows the batch, not the state. A batch that runs again after a failure
finds the state as it was before it and writes the same version: results are exactly once. Readers take each outcome from
its newest version; fold_versions puts old versions together, so that there are few to read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditspark.operators.records import compact_attempts, resolve_attempts
from auditspark.sources.tables import drop_version, versions


def stream_records(spark: SparkSession, source: str, schema: T.StructType, state: str, checkpoint: str, key: str, ordinal: str, ok: Column, payload: Sequence[str], files: int = 1):
    """Start the query over the JSONL files of a folder, so many a batch, until what is there has been read."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(source)
    return (
        compact_attempts(rows, key, ordinal, ok, payload)
        .writeStream.outputMode("update")
        .foreachBatch(lambda changed, number: put_version(changed, number, state))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def put_version(changed: DataFrame, number: int, state: str) -> None:
    changed.write.mode("overwrite").parquet(f"{state}/v={number}")


def _newest(spark: SparkSession, state: str, key: str) -> DataFrame:
    """(key, _ok, _p, _n, _first) of all outcomes. Counts only grow and first places only fall, so a group's newest
    version has the largest and the smallest of them."""
    base, numbers = versions(spark, state, "base="), versions(spark, state)
    paths = [f"{state}/base={n}" for n in base[-1:]] + [f"{state}/v={n}" for n in numbers if not base or n > base[-1]]
    return spark.read.parquet(*paths).groupBy(key, "_ok", "_p").agg(F.max("_n").alias("_n"), F.min("_first").alias("_first"))


def fold_versions(spark: SparkSession, state: str, key: str, keep: int = 2) -> None:
    """Put all versions there are into one base, and drop those that older bases hold too; the `keep` newest bases stay, for
    readers that have begun. It may run beside the stream, whose next versions come after; one runs at a time."""
    numbers, base = versions(spark, state), versions(spark, state, "base=")
    if not numbers or base and base[-1] >= numbers[-1]:
        return
    _newest(spark, state, key).write.mode("overwrite").parquet(f"{state}/base={numbers[-1]}")
    kept = [*base, numbers[-1]][-keep:]
    for n in numbers:
        if n <= kept[0] and len(kept) == keep:
            drop_version(spark, state, n)
    for n in base:
        if n < kept[0]:
            drop_version(spark, state, n, "base=")


def current(spark: SparkSession, state: str, key: str, ordinal: str) -> DataFrame:
    """The merged records as of the newest version."""
    return resolve_attempts(_newest(spark, state, key), key, ordinal)
