"""Result tables: writers, and publishing that never replaces a good table with a partial one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def write_table(df: DataFrame, path: str, kind: str = "parquet", small: bool = False) -> None:
    """Write as parquet, json or csv, values whole. small: one file, for summaries of a few rows."""
    writer = (df.coalesce(1) if small else df).write.mode("errorifexists")
    if kind == "csv":
        # quotes doubled and line ends kept inside quotes, so that any text survives
        writer.option("header", True).option("quote", '"').option("escape", '"').option("nullValue", "\\N").option("emptyValue", "").csv(path)
    else:
        writer.format(kind).save(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).option("nullValue", "\\N").option("emptyValue", "").csv(path)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def publish(df: DataFrame, path: str, at_least: int, keep: int = 2) -> bool:
    """Write beside the versions of a table, count what was written, and make it the newest version v=<n> only if it
    has rows enough. -> whether it was published.

    One rename makes it visible, to a name that isn't there yet, so readers (published) always find a whole table; a
    refused or failed write leaves the versions as they were, and a rename that fails is an error. The `keep` newest
    versions stay, for readers that have begun. A table has one publisher at a time.
    """
    spark = df.sparkSession
    temporary = f"{path}/_{uuid.uuid4().hex[:8]}.tmp"
    df.write.parquet(temporary)
    source, fs = _fs(spark, temporary)
    if spark.read.schema(df.schema).parquet(temporary).count() < at_least:
        fs.delete(source, True)
        return False
    before = versions(spark, path)
    target, _ = _fs(spark, f"{path}/v={before[-1] + 1 if before else 0}")
    if fs.exists(target) or not fs.rename(source, target):
        raise OSError(f"{temporary} could not be renamed to {target}")
    for n in before[: -(keep - 1) or None]:
        drop_version(spark, path, n)
    return True


def published(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of a published table."""
    found = versions(spark, path)
    if not found:
        raise FileNotFoundError(f"nothing is published at {path}")
    return spark.read.parquet(f"{path}/v={found[-1]}")


def versions(spark: SparkSession, path: str, prefix: str = "v=") -> list[int]:
    """Numbers of the complete versions v=<n> under a path, in order."""
    folder, fs = _fs(spark, path)
    if not fs.exists(folder):
        return []
    found = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith(prefix)]
    return sorted(int(p.getName()[len(prefix) :]) for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def drop_version(spark: SparkSession, path: str, n: int, prefix: str = "v=") -> None:
    p, fs = _fs(spark, f"{path}/{prefix}{n}")
    fs.delete(p, True)
