"""Every registered query of the library against its oracle on the smallest tables."""

import pytest
from pyspark.sql import functions as F

from auditspark.plans import registry
from auditspark.plans.messages import msg
from tests.differential import connect, difference

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_oracle(spark, con, name):
    assert difference(QUERIES[name](spark, SF), con, ORACLES[name]) is None


def test_what_has_no_oracle(spark):
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.queries()) >= set(QUERIES)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_floor_rows_reads_all_lines(spark):
    m = msg(spark, SF).select("writer", "class", "validator", "cid")
    got = [tuple(r) for r in QUERIES["floor_rows"](spark, SF).select(*m.columns).collect()]
    want = {tuple(r) for r in m.collect()}
    assert {r for r in got if r[3] != "(empty set)"} == want
    empty = {r[:3] for r in got if r[3] == "(empty set)"}
    assert empty and not empty & {r[:3] for r in want} and len(got) == len(want) + len(empty)


def test_nested_path_find_has_all_keys(spark, tmp_path):
    keys = range(1, 2601)
    spark.range(1, 2601).select(F.col("id").alias("p_partkey"), F.lit("t").alias("p_type")).write.parquet(str(tmp_path / "part.parquet"))
    want = {}
    for k in keys:
        want[k] = f"{want[k // 5][0]}/{k}" if k >= 5 else str(k), want[k // 5][1] + 1 if k >= 5 else 0
    got = QUERIES["nested_path_find"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {r["child"]: (r["path"], r["depth"]) for r in got} == want


def test_manifest_is_the_whole_plan(spark):
    rows = spark.read.parquet(f"{SF}/orders.parquet").filter("o_orderpriority IN ('1-URGENT', '2-HIGH')").collect()
    order = sorted(rows, key=lambda r: (r["o_orderpriority"], r["o_totalprice"], r["o_orderkey"]))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several ranges
    got = sorted(QUERIES["manifest"](spark, SF).collect(), key=lambda r: r["place"])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(rows) > 200
    assert [tuple(r[c] for c in ("uid", "class", "place")) for r in got] == [(r["o_orderkey"], r["o_orderpriority"], k + 1) for k, r in enumerate(order)]
