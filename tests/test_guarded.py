"""The guarded data source: whole results replace a table, others don't."""

import os

import pytest
from pyspark.sql import functions as F

from auditspark.sources import guarded, tables


@pytest.fixture
def path(spark, tmp_path):
    guarded.register(spark)
    return str(tmp_path / "t")


def write(df, path, **options):
    df.write.format("guarded").options(**options).mode("append").save(path)


def test_write_and_read_back(spark, path):
    df = spark.createDataFrame([(1, "a", None, [1.5]), (2, None, b"\\0x", []), (3, "ü\n\"", b"", None)], "id long, s string, b binary, d array<double>").repartition(3)
    write(df, path)
    back = spark.read.format("guarded").load(path)
    assert back.dtypes == df.dtypes and sorted(map(tuple, back.collect()), key=lambda r: r[0]) == sorted(map(tuple, df.collect()), key=lambda r: r[0])
    assert tables.published(spark, path).count() == 3
    write(df.limit(2), path)
    write(df.limit(1), path)
    assert spark.read.format("guarded").load(path).count() == 1 and tables.versions(spark, path) == [1, 2]


def test_a_short_write_is_refused(spark, path):
    df = spark.range(100)
    write(df, path, at_least=100)
    with pytest.raises(Exception, match="the table needs 100"):
        write(df.filter("id > 5"), path, at_least=100)
    with pytest.raises(Exception, match="the table needs 1"):
        write(df.limit(0), path)
    assert spark.read.format("guarded").load(path).count() == 100 and os.listdir(path) == ["v=0"]


def test_a_task_that_fails_or_dies_leaves_the_old_version(spark, path):
    write(spark.range(100), path)
    bad = spark.range(0, 100, 1, 4).withColumn("id", F.when(F.col("id") == 77, F.raise_error(F.lit("broken row"))).otherwise(F.col("id")))
    with pytest.raises(Exception, match="broken row"):
        write(bad, path)

    def die(batches):
        for batch in batches:
            if 42 in batch.column(0).to_pylist():
                os._exit(1)
            yield batch

    with pytest.raises(Exception):  # noqa: B017
        write(spark.range(0, 100, 1, 4).mapInArrow(die, "id long"), path)
    assert spark.read.format("guarded").load(path).count() == 100 and tables.versions(spark, path) == [0]


def test_the_commit_checks_files(tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    writer = guarded.Writer(str(tmp_path / "t"), 1, 2)
    folder = tmp_path / "t" / writer.folder
    os.makedirs(folder)
    for name in ("kept", "left over"):
        pq.write_table(pa.table({"id": [1, 2]}), folder / f"{name}.parquet")
    with pytest.raises(OSError, match="its task wrote 3"):
        writer.commit([guarded.Written("kept.parquet", 3)])
    with pytest.raises(OSError, match="no message"):
        writer.commit([guarded.Written("kept.parquet", 2), None])
    writer.commit([guarded.Written("kept.parquet", 2), guarded.Written(None, 0)])
    assert sorted(os.listdir(tmp_path / "t" / "v=0")) == ["_SUCCESS", "kept.parquet"]


def test_nothing_is_there(spark, path):
    with pytest.raises(Exception, match="nothing is published"):
        spark.read.format("guarded").load(path).count()
