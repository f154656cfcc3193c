"""Global places, lookups and batches against sequential code; findings of sectioned logs against a hand-made log."""

import random
from bisect import bisect_right

import pytest
from pyspark.sql import functions as F

from auditspark.operators import census as C
from auditspark.operators import findings as M
from auditspark.operators.quantiles import quantiles
from auditspark.operators.ranges import last_before, numbered, numbered_within
from auditspark.operators.records import byte_batches
from auditspark.plans.messages import SECTION_KINDS


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_numbered(many_ranges):
    rng = random.Random(1)
    rows = [(k, rng.choice([None, 1, 5]), rng.randint(0, 9)) for k in rng.sample(range(1000), 300)]
    df = many_ranges.createDataFrame(rows, "id long, size long, _n int")
    got = sorted(numbered(df, [F.col("id")], sums=["size"]).collect())
    before = 0
    for place, (r, want) in enumerate(zip(got, sorted(rows), strict=True)):
        assert (r["id"], r["place"], r["before_size"]) == (want[0], place + 1, before)
        before += want[1] or 0
    assert numbered(df.limit(0), [F.col("id")]).collect() == []


def test_last_before(many_ranges):
    rng = random.Random(2)
    values = sorted(rng.randint(10, 60) for _ in range(200))
    probes = [(rng.randint(0, 70), k) for k in range(150)]
    got = last_before(many_ranges.createDataFrame(list(zip(values, range(200), strict=True)), "value long, n long"), many_ranges.createDataFrame(probes, "value long, id long"))
    want = {k: bisect_right(values, v) - 1 for v, k in probes}
    assert {r["id"]: r["n"] for r in got.collect()} == {k: None if n < 0 else n for k, n in want.items()}


def fold(rows, cap, most):
    out, held, count, batch = {}, 0, 0, 0
    for key, size in rows:
        if count and (held + (size or 0) > cap or count >= most):
            batch, held, count = batch + 1, 0, 0
        held, count = held + (size or 0), count + 1
        out[key] = (size or 0, batch)
    return out


@pytest.mark.parametrize(("block", "most", "top"), [(7, 4, 50), (64, 48, 200), (5, 100, 12), (100_000, 12, 90)])
def test_byte_batches_equal_the_fold(many_ranges, block, most, top):
    """Sizes of 0, null and over the cap; batches longer than a block; a third of the rows of one size."""
    rng = random.Random(block)
    rows = [(k, rng.choice([None, 0, 30, 30, rng.randint(0, top), rng.randint(0, 5)])) for k in range(400)]
    df = many_ranges.createDataFrame(rows, "id long, size long").orderBy(F.rand(1)).repartition(3)
    got = byte_batches(df, [F.col("id")], "size", "id", 100, most, block)
    assert {r["key"]: (r["size"], r["batch"]) for r in got.collect()} == fold(rows, 100, most)


def test_byte_batches_of_nothing_and_one(spark):
    df = spark.createDataFrame([(1, 500)], "id long, size long")
    assert byte_batches(df.limit(0), [F.col("id")], "size", "id", 100, 3).collect() == []
    assert [tuple(r) for r in byte_batches(df, [F.col("id")], "size", "id", 100, 3).collect()] == [(1, 500, 0)]


LOG = """a line before
  another
SOP class is "1.2.3" (First type)
==========
Errors
======
Module "Patient":
Tag (0010,0010) is missing
  Tag (0010,0020) stands in it
(0040,0260) (Sequence):
  Tag (0040,0254) is empty
\tand so is this
  (0040,0275) (Inner):
    Tag (0040,0007) is inside
plain flush text is none
  Tag (0040,0008) too
Tag (0010,0030) has no parent
  Tag (0040,0009) after it
Module "Study": 3 problems
  Tag (0008,0050) here

Warnings  
  Tag (0008,0051) warned
SOP class is "9" (Last type)"""


def test_sectioned_log(spark):
    logs = spark.createDataFrame([(1, LOG), (2, None), (3, "Tag x\nModule \"A\":\n(0010,0010):\nErrors\n  y\r\n==\n")], "id long, text string")
    banner, section, module, context, flush = SECTION_KINDS
    got = M.split_sectioned(logs, ["id"], "text", section, module, context, banner, flush).orderBy("id", "pos").collect()
    assert [r["message"] for r in got if r["id"] == 1] == [
        "Module <Patient>  Tag (0010,0010) is missing",
        "Module <Patient>  Tag (0010,0020) stands in it",
        "Module <Patient> (0040,0260) (Sequence) Tag (0040,0254) is empty",
        "Module <Patient> (0040,0260) (Sequence) and so is this",
        "Module <Patient> (0040,0275) (Inner) Tag (0040,0007) is inside",
        "Module <Patient> (0040,0275) (Inner) Tag (0040,0008) too",
        "Module <Patient>  Tag (0010,0030) has no parent",
        "Module <Patient>  Tag (0040,0009) after it",
        "Module <Study>  Tag (0008,0050) here",
        "Module <Study>  Tag (0008,0051) warned",
    ]
    assert [r["severity"] for r in got] == ["ERROR"] * 9 + ["WARNING", "ERROR"] and {r["banner"] for r in got if r["id"] == 1} == {"Last type"}
    assert tuple(got[-1]) == (3, 4, None, "ERROR", "A", "(0010,0010)", True, "y", "Module <A> (0010,0010) y")


@pytest.mark.parametrize("seed", [1, 2])
def test_quantiles_equal_percentile(many_ranges, seed):
    """A group with a third of the rows, groups of one and two values, nulls in key and value."""
    rng = random.Random(seed)
    rows = [(rng.choice(["hot", "a", "b", None]), rng.choice([None, 0.5, 7.25, rng.random(), float(rng.randint(-3, 3))])) for _ in range(600)]
    rows += [("one", 3.5), ("two", 1.0), ("two", 2.0), ("void", None)]
    df = many_ranges.createDataFrame(rows, "k string, v double").withColumn("extra", F.lit(1))
    at = {"q1": 0.25, "q2": 0.5, "q9": 0.9, "least": 0.0, "most": 1.0}
    got = {r["k"]: tuple(r)[1:] for r in quantiles(df, ["k"], "v", at).collect()}
    want = {r["k"]: tuple(r["q"]) for r in df.groupBy("k").agg(F.percentile("v", F.array(*[F.lit(q) for q in at.values()])).alias("q")).collect() if r["q"]}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    whole = quantiles(df, [], "v", {"m": 0.5}).first()["m"]
    assert whole == pytest.approx(df.agg(F.percentile("v", 0.5)).first()[0])
    assert quantiles(df.limit(0), ["k"], "v", at).collect() == []


def test_quantiles_hold_no_group_in_a_buffer(spark):
    plan = quantiles(spark.createDataFrame([("a", 1.0)], "k string, v double"), ["k"], "v", {"m": 0.5})._jdf.queryExecution().toString()
    assert "percentile" not in plan and "collect" not in plan


def test_numbered_within(many_ranges):
    rng = random.Random(9)
    rows = [(rng.choice(["hot", "hot", "a", None]), k) for k in rng.sample(range(1000), 200)]
    got = numbered_within(many_ranges.createDataFrame(rows, "k string, v long"), ["k"], [F.desc("v")])
    for group in ("hot", "a", None):
        own = sorted((r for r in got.collect() if r["k"] == group), key=lambda r: r["place"])
        assert [r["v"] for r in own] == sorted((v for k, v in rows if k == group), reverse=True)
        assert [r["place"] for r in own] == list(range(1, len(own) + 1)) and {r["of_group"] for r in own} == {len(own)}


def test_counts_go_up_in_two_levels(spark):
    """Two distinct counts in one aggregate would multiply the rows first (Expand)."""
    df = spark.createDataFrame([("a", "c", "p", "n", 1, 2.0, "x", "y")], "class string, collection string, patient string, analysis string, instances long, mb double, maker string, model string")
    for counted in (C.census(df, ["class"]), C.population(df, ["maker", "model"], ["class"]), C.totals(df)):
        assert "Expand" not in counted._jdf.queryExecution().executedPlan().toString()
    null = df.select(F.lit(None).cast("string").alias("class"), *df.columns[1:])
    assert [tuple(r) for r in C.census(null.unionByName(null), ["class"]).collect()] == [(None, 2, 2, 0.004, 2.0, 1, 1)]
