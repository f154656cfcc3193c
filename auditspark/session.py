"""Session and shared-folder helpers used by every operator."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "auditspark", cpus: int | None = None) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    n = cpus or os.cpu_count() or 1
    spark = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("AUDITSPARK_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give the workers this package, once for each context, as --py-files would: a notebook or driver whose
    workers start in another folder can't import it otherwise."""
    context = spark.sparkContext
    if not getattr(context, "_auditspark_shipped", False):
        package = Path(__file__).resolve().parent
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='auditspark-code-')}/{package.name}", "zip", package.parent, package.name)
        context.addPyFile(archive)
        context._auditspark_shipped = True


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is spark.checkpoint.dir where the session names one. Where that is unset, a local session gets a folder of
    its own; on a cluster that is an error, as executors can't see the driver's temporary folders.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="auditspark-shared-")
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return shared_dir(spark)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/auditspark-{uuid.uuid4().hex[:12]}/{name}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path.rsplit("/", 1)[0])
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop)
    fs.deleteOnExit(hadoop)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, so the loss of an
    executor costs a re-read, never a recomputation of everything before."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
