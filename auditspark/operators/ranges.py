"""Places, running sums and last-before lookups over one global order, without a task that holds all rows.

A table is cut into ranges of its order, one for each partition; within a range a window counts, and sums over the ranges
(a row for each range) say what comes before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditspark.session import materialise


def _ranges(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    return materialise(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), name)


def numbered(df: DataFrame, order: Sequence[Column], place: str = "place", sums: Sequence[str] = ()) -> DataFrame:
    """df with its place in the order, from 1, and for each of the long columns `sums` the sum of the rows before, as
    before_<column>; names that begin with two underscores are ours. The order should end in a key: ranges are cut between rows that differ in it."""
    held = _ranges(df, order, "ranges")
    per = held.groupBy("__range").agg(F.count("*").alias("__n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(f"__s{k}") for k, c in enumerate(sums)])
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    totals = ["__n", *[f"__s{k}" for k in range(len(sums))]]
    offsets = per.select("__range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in totals])
    inside = Window.partitionBy("__range").orderBy(*order)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    own = [(F.coalesce(F.sum(c).over(earlier), F.lit(0)) + F.col(f"__s{k}")).alias(f"before_{c}") for k, c in enumerate(sums)]
    return held.join(F.broadcast(offsets), "__range").select(*df.columns, (F.row_number().over(inside) + F.col("__n")).cast("long").alias(place), *own)


def numbered_within(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """df with each row's place in its group, from 1, and the number of the group's rows, of_group; null keys are a group.
    Groups lie in many ranges, so a large one is in no task as a whole."""
    whole = numbered(df, [*[F.asc_nulls_first(k) for k in keys], *order], "__place")
    held = materialise(whole, "places")
    groups = held.groupBy(*keys).agg(F.min("__place").alias("__first"), F.count("*").alias("of_group"))
    points = held.select(F.col("__place").alias("value"), F.col("__place").alias("id"))
    # a group's first place is the last first place that is no larger
    begun = last_before(groups.select(F.col("__first").alias("value"), F.col("__first").alias("n")), points)
    sized = begun.join(groups.select(F.col("__first").alias("n"), "of_group"), "n")
    return held.join(sized, F.col("__place") == F.col("id")).select(*df.columns, (F.col("__place") - F.col("n") + 1).alias("place"), "of_group")


def last_before(points: DataFrame, probes: DataFrame) -> DataFrame:
    """points(value, n), probes(value, id) -> (id, n): of the points whose value is no larger than the probe's the largest
    n; null if there is none. n grows with the value."""
    both = points.select("value", F.lit(0).alias("kind"), "n", F.lit(None).cast("long").alias("id")).unionByName(probes.select("value", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("n"), "id"))
    order = [F.asc("value"), F.asc("kind"), F.asc("n"), F.asc("id")]
    held = _ranges(both, order, "lookup")
    per = held.groupBy("__range").agg(F.max("n").alias("_n"))
    carried = per.select("__range", F.max("_n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)).alias("_n"))  # a row for each range
    inside = F.max("n").over(Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    found = held.withColumn("_own", inside).join(F.broadcast(carried), "__range")
    return found.filter("kind = 1").select("id", F.coalesce(F.greatest("_own", "_n"), "_own", "_n").alias("n"))
