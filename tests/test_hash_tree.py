"""Tables compared by a hash tree against comparing their rows."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from auditspark.operators import findings as M

SCHEMA = "a long, b string, c double"


def some(rng, n):
    return [(rng.choice([None, rng.randint(0, 5)]), rng.choice([None, "", "x", "y"]), rng.choice([None, 0.5, -0.0, 0.0, float("nan")])) for _ in range(n)]


def key(row):
    return tuple("nan" if isinstance(v, float) and v != v else v for v in row)


@pytest.mark.parametrize("seed", range(4))
def test_equals_comparing_rows(spark, seed):
    """Nulls that change places, repeated rows, zeros of both signs, NaN."""
    rng = random.Random(seed)
    first = some(rng, 200)
    second = list(first)
    rng.shuffle(second)
    if seed:
        second = second[seed:] + some(rng, 2) + first[:1]
    x, y = Counter(map(key, first)), Counter(map(key, second))
    got = M.table_difference(spark.createDataFrame(first, SCHEMA), spark.createDataFrame(second, SCHEMA)).first()
    assert (got["only_first"], got["only_second"], got["equal"]) == ((x - y).total(), (y - x).total(), x == y)


def test_nulls_in_different_columns_differ(spark):
    one, two = (spark.createDataFrame([r], "a string, b string") for r in (("x", None), (None, "x")))
    assert not M.table_difference(one, two).first()["equal"]


def test_rows_shuffled_follow_the_difference(spark):
    big = spark.range(200_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("v"))
    other = big.withColumn("v", F.when(F.col("id") == 77_777, "changed").otherwise(F.col("v")))
    left, right = M.unlike_rows(big, other)
    assert left.count() + right.count() <= 6
    got = M.table_difference(big, other).first()
    assert (got["only_first"], got["only_second"], got["equal"]) == (1, 1, False) and got["first_difference"].startswith("77777|")
    same = M.unlike_rows(big, big.repartition(5))
    assert same[0].isEmpty() and same[1].isEmpty()


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert M.table_difference(none, none).first()["equal"]
    assert M.table_difference(none, spark.createDataFrame([(1, "x", 1.0)], SCHEMA)).first()["only_second"] == 1
