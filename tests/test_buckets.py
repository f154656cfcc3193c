"""Tables in buckets: upserts and look-ups that don't move them."""

import re
import uuid

import pytest
from pyspark.sql import functions as F

from auditspark.operators import claims as G
from auditspark.operators import records as L
from auditspark.session import scratch_path
from auditspark.sources import buckets as B


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def table(spark, n=1000):
    name, path = f"t_{uuid.uuid4().hex[:8]}", scratch_path(spark, "t")
    df = spark.range(n).select(F.col("id").cast("string").alias("id"), F.lit("old").alias("claim"), F.when(F.col("id") % 10 == 0, "RETIRED").otherwise("MEASURED").alias("status"))
    B.create(df, name, "id", 8, path)
    return df, name, path


def new_rows(spark):
    return spark.createDataFrame([("0", "new", "MEASURED"), ("5", None, "DERIVED"), ("x", "new", "PENDING")], "id string, claim string, status string")


def test_only_new_rows_are_shuffled(no_broadcast):
    spark = no_broadcast
    _, name, _ = table(spark)
    merged = G.sticky_upsert(B.read(spark, name), new_rows(spark), "id", {"status": "RETIRED"})
    old, new = plan_of(merged).split("SortMergeJoin", 1)[1].split("Scan ExistingRDD", 1)[0].split("FileScan", 1)
    assert "Exchange" not in old and "SelectedBucketsCount: 8 out of 8" in new
    assert len(re.findall(r"Exchange hashpartitioning", plan_of(merged))) == 1  # above the new rows


def test_upserts_make_versions(spark):
    df, name, path = table(spark)
    new = new_rows(spark)
    want = {tuple(r) for r in G.sticky_upsert(df, new, "id", {"status": "RETIRED"}).collect()}
    B.change(spark, name, "id", 8, path, lambda old: G.sticky_upsert(old, new, "id", {"status": "RETIRED"}))
    assert {tuple(r) for r in B.read(spark, name).collect()} == want and B.versions(spark, name) == [0, 1]
    assert ("0", "new", "RETIRED") in want and ("5", "old", "DERIVED") in want and ("x", "new", "PENDING") in want
    B.change(spark, name, "id", 8, path, lambda old: G.sticky_upsert(old, new, "id", {"status": "RETIRED"}))
    assert B.versions(spark, name) == [1, 2] and {tuple(r) for r in B.read(spark, name).collect()} == want
    with pytest.raises(Exception, match="no such thing"):
        B.change(spark, name, "id", 8, path, lambda old: old.withColumn("claim", F.raise_error(F.lit("no such thing"))))
    assert B.versions(spark, name) == [1, 2] and B.read(spark, name).count() == 1001
    with pytest.raises(ValueError, match="there already"):
        B.create(df, name, "id", 8, path)


def test_pending_moves_neither_side(no_broadcast):
    spark = no_broadcast
    _, plan, _ = table(spark)
    log = f"t_{uuid.uuid4().hex[:8]}"
    B.create(spark.range(0, 1000, 3).select(F.col("id").cast("string").alias("id")), log, "id", 8, scratch_path(spark, "log"))
    left = L.pending(B.read(spark, plan).select("id"), B.read(spark, log), "id")
    assert "Exchange" not in plan_of(left)
    assert {r["id"] for r in left.collect()} == {str(k) for k in range(1000) if k % 3}
