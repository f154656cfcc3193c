"""Stratified sampling under a byte budget, and rates from such samples."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditspark.session import materialise


#: Strata (a name and a number each) up to which an allocation is broadcast.
BROADCAST_STRATA = 100_000


def strata(df: DataFrame, stratum: str, size: str, cluster: str, patient: str, instances: str) -> DataFrame:
    """Per stratum: series, instances, mb, mean_mb, sd_mb (0 for one row), collections, patients, largest_pct and the
    sizes of its clusters, largest first. Two levels, so a stratum's rows never meet in one task."""
    per = df.groupBy(stratum, cluster).agg(F.count("*").alias("n"))
    sizes = per.groupBy(stratum).agg(F.sort_array(F.collect_list("n"), asc=False).alias("sizes"), (100.0 * F.max("n") / F.sum("n")).alias("largest_pct"))
    flat = df.groupBy(stratum).agg(
        F.count("*").alias("series"), F.sum(instances).alias("instances"), F.sum(size).alias("mb"), F.avg(size).alias("mean_mb"), F.coalesce(F.stddev_samp(size), F.lit(0.0)).alias("sd_mb"), F.count_distinct(cluster).alias("collections"), F.count_distinct(patient).alias("patients")
    )
    return flat.join(sizes, stratum)


def allocate_at(strata_: DataFrame, cap: float, registered: int = 384, least: int = 30) -> DataFrame:
    """strata with n: all of a small stratum, else what the cap allows of the registered number, at least some."""
    by_cap = F.greatest(F.lit(least).cast("long"), F.floor(F.lit(cap) / F.col("mean_mb")).cast("long"))
    return strata_.withColumn("n", F.when(F.col("series") <= registered, F.col("series")).otherwise(F.least(F.lit(registered).cast("long"), by_cap)))


def allocate(strata_: DataFrame, budget: float, registered: int = 384, least: int = 30, deviations: float = 3.0) -> DataFrame:
    """The largest cap with expected size + deviations * its standard deviation within the budget, by bisection.

    The table of strata has a row for each stratum; it is aggregated once, and the bisection runs on those rows.
    """
    rows = [(x["series"], x["mean_mb"], x["sd_mb"]) for x in strata_.select("series", "mean_mb", "sd_mb").collect()]

    def cost(cap: float) -> float:
        mean = var = 0.0
        for series, m, sd in rows:
            n = series if series <= registered else min(registered, max(least, math.floor(cap / m) if m else registered))  # as allocate_at has it
            mean += n * m
            var += n * sd * sd * (1 - n / series)
        return mean + deviations * var**0.5

    lo, hi = 0.0, max([registered * m for _, m, _ in rows], default=0.0) + 1
    if cost(hi) > budget:
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if cost(mid) <= budget else (lo, mid)
        hi = lo
    return allocate_at(strata_, hi, registered, least).select("stratum", "series", "n", F.round(F.col("n") * F.col("mean_mb"), 2).alias("expected_mb"))


def rank(df: DataFrame, stratum: str, uid: str, seed: int, *carried: str, registered: int = 384) -> DataFrame:
    """(stratum, uid, place and the carried columns): rows in the order of a hash within their stratum, as far as any
    allocation can reach: all of a stratum of at most `registered` rows, of others that many.

    Large strata are cut to that many before they are shuffled (a group limit), so no task sorts a whole one."""
    key = F.sha2(F.concat(F.lit(f"{seed}|"), F.col(stratum), F.lit("|"), F.col(uid).cast("string")), 256)
    w = Window.partitionBy(stratum).orderBy("_key", uid)
    return df.select(stratum, uid, *carried, key.alias("_key")).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= registered).drop("_key")


def draw(df: DataFrame, sizes: DataFrame, stratum: str, uid: str, seed: int, registered: int = 384) -> DataFrame:
    """(stratum, uid, place): the first n of each stratum in the order of a hash, so that a larger n only extends a
    sample. sizes(stratum, n), a row for each stratum, where n is at most `registered`."""
    return drawn(rank(df, stratum, uid, seed, registered=registered), sizes, stratum).select(stratum, uid, "place")


def drawn(ranked: DataFrame, allocation: DataFrame, stratum: str) -> DataFrame:
    """The rows of rank() that an allocation(stratum, n) takes."""
    sizes = materialise(allocation.select(stratum, "n"), "sizes")
    few = sizes.limit(BROADCAST_STRATA + 1).count() <= BROADCAST_STRATA
    return ranked.join(F.broadcast(sizes) if few else sizes, stratum).filter("place <= n").drop("n")


def drawn_size(ranked: DataFrame, allocation: DataFrame, stratum: str, size: str) -> float:
    """What the rows that an allocation(stratum, n) draws add up to."""
    return drawn(ranked, allocation, stratum).agg(F.sum(size).alias("s")).first()["s"] or 0.0


def byte_gate(ranked: DataFrame, strata_: DataFrame, stratum: str, size: str, cap: float, budget: float, step: float = 0.95, registered: int = 384, least: int = 30) -> DataFrame:
    """The allocation at the first cap, shrunk step by step, whose drawn rows fit the budget: strata with n and `fired`, how
    often the cap was shrunk. The order of the rows stays, so a smaller n takes a prefix. If nothing more can be cut and the
    budget is still exceeded, that is an error.

    The rows' running sums are written once; what the allocations of some steps draw is looked up there together."""
    spark = ranked.sparkSession
    w = Window.partitionBy(stratum).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    sums = materialise(ranked.select(stratum, "place", F.sum(size).over(w).alias("_sum")), "sums")
    rows = strata_.select(stratum, "series", "mean_mb").collect()  # a row for each stratum

    def sizes(cap: float) -> list[int]:
        return [r["series"] if r["series"] <= registered else min(registered, max(least, int(cap // r["mean_mb"]) if r["mean_mb"] else registered)) for r in rows]

    fired, before, floor_ = 0, None, sizes(0.0)
    while True:
        steps: list[tuple[int, list[int]]] = []
        while len(steps) < 16 and before != floor_:
            n = sizes(cap * step**fired)
            if n != before:
                steps.append((fired, n))
            before, fired = n, fired + 1
        if not steps:
            raise ValueError("the least allocation exceeds the budget")
        plans = spark.createDataFrame([(k, r[stratum], m) for k, n in steps for r, m in zip(rows, n, strict=True)], f"_k int, {stratum} string, place int")
        drawn_ = {r["_k"]: r["s"] or 0.0 for r in plans.join(sums, [stratum, "place"]).groupBy("_k").agg(F.sum("_sum").alias("s")).collect()}
        for k, _ in steps:
            if drawn_.get(k, 0.0) <= budget:
                return allocate_at(strata_, cap * step**k, registered, least).withColumn("fired", F.lit(k))


def population_rate(sample: DataFrame, sizes: DataFrame, stratum: str, cluster: str, y: str) -> DataFrame:
    """One row: n, pct, se_design (with the finite population correction), se_clustered (ultimate clusters; strata
    with a single one are put together for the variance), df."""
    h = sample.groupBy(stratum).agg(F.count("*").alias("n"), F.avg(y).alias("p"), F.coalesce(F.var_samp(y), F.lit(0.0)).alias("v"), F.count_distinct(cluster).alias("psus"))
    h = h.join(sizes.select(stratum, F.col("series").cast("double").alias("big")), stratum).withColumn("vs", F.when(F.col("psus") == 1, "(single)").otherwise(F.col(stratum)))
    total = h.agg(F.sum("big").alias("w"), (F.sum(F.col("big") * F.col("p")) / F.sum("big")).alias("rate"), F.sum(F.col("big") * F.col("big") * (1 - F.col("n") / F.col("big")) * F.col("v") / F.col("n")).alias("vd"), F.sum("n").alias("nn"))
    per = sample.groupBy(stratum, cluster).agg(F.sum(y).alias("sy"), F.count("*").alias("m"))
    z = per.join(h.select(stratum, "vs", "big", "n"), stratum).join(total.select("rate")).select("vs", (F.col("big") / F.col("n") * (F.col("sy") - F.col("m") * F.col("rate"))).alias("e"))
    f = h.groupBy("vs").agg((F.sum("n") / F.sum("big")).alias("f"))
    v = z.groupBy("vs").agg(F.count("*").alias("k"), F.sum("e").alias("s"), F.sum(F.col("e") * F.col("e")).alias("ss")).join(f, "vs")
    part = F.when(F.col("k") > 1, (1 - F.col("f")) * F.col("k") / (F.col("k") - 1) * (F.col("ss") - F.col("s") * F.col("s") / F.col("k"))).otherwise(0.0)
    one = v.agg(F.sum(part).alias("vc"), (F.sum("k") - F.count("*")).alias("df")).join(total)
    return one.select(F.col("nn").alias("n"), F.round(100 * F.col("rate"), 4).alias("pct"), F.round(100 * F.sqrt("vd") / F.col("w"), 6).alias("se_design"), F.round(100 * F.sqrt("vc") / F.col("w"), 6).alias("se_clustered"), "df")
