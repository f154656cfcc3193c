"""Exact quantiles of all groups at once, by selection in one global order; no task holds a group's values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditspark.operators.ranges import last_before, numbered
from auditspark.session import materialise


def quantiles(df: DataFrame, keys: Sequence[str], value: str, at: Mapping[str, float]) -> DataFrame:
    """(keys, a double for each name of `at`): the quantiles of each group's values, between two neighbours interpolated.

    Equal values are counted before anything is sorted. Counts are summed along the order of (keys, value), in ranges; a
    group's ranks are places in that order, and each wanted place is looked up there.

    Nulls are no values; a group without a value has no row; null keys are a group; NaN is the largest value.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("value")).agg(F.count("*").alias("n"))
    order = [*[F.asc_nulls_first(k) for k in keys], F.asc("value")]
    placed = materialise(numbered(counted, order, "place", ["n"]), "placed")
    groups = placed.groupBy(*keys).agg(F.min("before_n").alias("start"), F.sum("n").alias("total"))
    wanted = [F.struct(F.lit(name).alias("name"), (F.lit(q) * (F.col("total") - 1)).alias("at")) for name, q in at.items()]
    each = groups.select(*keys, "start", F.explode(F.array(*wanted)).alias("w")).select(*keys, "start", "w.name", "w.at", F.explode(F.array(F.floor("w.at"), F.ceil("w.at"))).alias("rank"))
    each = materialise(each.distinct().withColumn("id", F.monotonically_increasing_id()), "wanted")
    found = last_before(placed.select(F.col("before_n").alias("value"), F.col("place").alias("n")), each.select((F.col("start") + F.col("rank")).alias("value"), "id"))
    valued = found.join(placed.select(F.col("place").alias("n"), F.col("value").alias("v")), "n").join(each, "id")
    # the weight of a neighbour is how near it is; a quantile that is a value has that one only
    part = F.when(F.col("rank") == F.col("at"), F.col("v")).otherwise((1 - F.abs(F.col("rank") - F.col("at"))) * F.col("v"))
    return valued.groupBy(*keys).agg(*[F.sum(F.when(F.col("name") == name, part)).alias(name) for name in at])
