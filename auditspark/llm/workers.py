"""What a Python worker keeps from one task to the next.

Workers outlive a stage. What an operator has built up for its tasks (the words it has met) is of no use to the next
operator, and would take from its memory; so one thing is kept at a time, and an operator that keeps nothing starts
with drop().
"""

from __future__ import annotations

import gc
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_kept: dict = {}


def keep(name: tuple, make):
    """The thing of this name, made where the worker doesn't hold it; anything else that it holds goes."""
    if name not in _kept:
        drop()
        _kept[name] = make()
    return _kept[name]


def drop() -> None:
    """Free what an earlier operator left in this worker."""
    import pyarrow as pa

    if _kept:
        _kept.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Rows of an Arrow batch, for what is run inside: wide rows in fewer at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def spread(docs: DataFrame) -> DataFrame:
    """docs over as many partitions as there are cores, where a table of few files or row groups has fewer."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs
