"""Statistics as Column expressions and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z = 1.959963984540054


def percent(part: Column, whole: Column, digits: int | None = 2) -> Column:
    """100 * part / whole, null for an empty whole."""
    value = F.when(whole != 0, 100.0 * part / whole)
    return value if digits is None else F.round(value, digits)


def wilson(k: Column, n: Column, z: float = Z) -> Column:
    """struct(lo, hi, half) of the Wilson interval, clamped to [0, 1]; nulls without observations."""
    p = k / n
    wide = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / wide
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / wide
    lo, hi = F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)
    ok = n > 0
    return F.struct(F.when(ok, lo).alias("lo"), F.when(ok, hi).alias("hi"), F.when(ok, (hi - lo) / 2).alias("half"))


def reporting_rule(n: Column, counts_below: int = 30, flagged_below: int = 384) -> Column:
    return F.when(n < counts_below, "counts only").when(n < flagged_below, "flagged").otherwise("rate")


def design_effect(mean_size: Column, rho: Column) -> Column:
    return 1 + (mean_size - 1) * rho


def icc(df: DataFrame, keys: list[str], cluster: str, y: str) -> DataFrame:
    """Per group of keys: clusters, n, m0 and the one-way random-effects intraclass correlation (clusters of
    unequal size); null for fewer than two clusters, without residual freedom or without variance. Two-level
    aggregation: a cluster's rows never meet in one task."""
    v = F.col(y).cast("double")
    per = df.groupBy(*keys, cluster).agg(F.count(v).alias("m"), F.sum(v).alias("s"), F.sum(v * v).alias("ss")).filter(F.col("m") > 0)
    tot = per.groupBy(*keys).agg(F.count("*").alias("clusters"), F.sum("m").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum(F.col("s") * F.col("s") / F.col("m")).alias("sm"), F.sum(F.col("m") * F.col("m")).alias("mm"))
    k, n = F.col("clusters"), F.col("n")
    between = (F.col("sm") - F.col("s") * F.col("s") / n) / (k - 1)
    within = (F.col("ss") - F.col("sm")) / (n - k)
    m0 = (n - F.col("mm") / n) / (k - 1)
    rho = (between - within) / (between + (m0 - 1) * within)
    ok = (k > 1) & (n > k)
    flat = F.abs(F.col("ss") - F.col("s") * F.col("s") / n) < 1e-12
    return tot.select(*keys, "clusters", "n", F.when(ok, m0).alias("m0"), F.when(ok & ~flat, rho).alias("icc"))


HALF_LOG_2PI = 0.9189385332046727
#: From here on four terms of Stirling's series are exact to a double's last digits.
LARGE = 16


def _series(x: Column) -> Column:
    return 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x > 0: Stirling's series at x + LARGE, less the factors between."""
    z = x + LARGE
    between = F.aggregate(F.sequence(F.lit(0), F.lit(LARGE - 1)), F.lit(0.0), lambda acc, i: acc + F.log(x + i))
    return (z - 0.5) * F.log(z) - z + HALF_LOG_2PI + _series(z) - between


def _beyond(x: Column) -> Column:
    """What Stirling's formula leaves of ln x!, for whole x > 0."""
    return F.when(x >= LARGE, _series(x)).otherwise(log_gamma(x + 1) - (x + 0.5) * F.log(x) + x - HALF_LOG_2PI)


def log_miss(size: Column, total: Column, drawn: Column) -> Column:
    """ln of the chance that a simple random sample without replacement of `drawn` from `total` has none of a
    cluster of `size`; -infinity if it can't miss. Its cost doesn't depend on the sample's size.

    It is the same with size and sample exchanged; with m the smaller and n the larger, it is ln of b! / (b - m)! less ln of
    total! / (total - m)!, with b = total - n. Factorials of large numbers would cancel to nothing, so Stirling's formula is put
    in and the terms that are equal are taken out.
    """
    whole = total.cast("double")
    m, n = F.least(size, drawn).cast("double"), F.greatest(size, drawn).cast("double")
    a, b = whole - m, whole - n
    r = b - m
    log_share = lambda x, of: F.when(2 * x > of, F.log1p((x - of) / of)).otherwise(F.log(x / of))
    rest = F.when(r >= LARGE, -(r + 0.5) * log_share(r, b) - _beyond(r)).otherwise((r + 0.5) * F.log(b) - r + HALF_LOG_2PI - log_gamma(r + 1))
    value = m * log_share(b, whole) + (a + 0.5) * log_share(a, whole) + _beyond(a) + _beyond(b) - _beyond(whole) + rest
    return F.when(m == 0, F.lit(0.0)).when(r < 0, F.lit(float("-inf"))).otherwise(value)


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, agreement, expected, Cohen's kappa (null if agreement is certain). Pairs with a null don't count."""
    known = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    cells = known.groupBy(a, b).agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("same"))
    left = cells.groupBy(F.col(a).alias("label")).agg(F.sum("n").alias("na"))
    right = cells.groupBy(F.col(b).alias("label")).agg(F.sum("n").alias("nb"))
    chance = left.join(right, "label").agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("both"))
    # two one-row tables
    one = total.join(chance)
    po, pe = F.col("same") / F.col("n"), F.col("both") / (F.col("n") * F.col("n"))
    return one.select(F.col("n"), po.alias("agreement"), pe.alias("expected"), F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"))


def smallest_n(p: Column, half: Column, z: float = Z) -> Column:
    """The smallest n whose Wilson interval for the rate p is at most 2 * half wide, for any half above 0. In u = 1 / n the
    squared condition is a quadratic, a u^2 + b u <= half^2; its root is rounded and put right by one where needed."""
    variance, square = p * (1 - p), half * half
    a, b = z**4 * (0.25 - square), z * z * (variance - 2 * square)
    root = F.sqrt(b * b + 4 * a * square)
    # the smaller of the roots' forms that doesn't cancel
    n = F.when(half >= 0.5, F.lit(1.0)).otherwise((b + root) / (2 * square))
    near = F.greatest(F.lit(1), F.round(n).cast("long"))
    fits = lambda m: z * F.sqrt(variance / m + z * z / (4 * m * m)) / (1 + z * z / m) <= half
    return F.coalesce(*[F.when((near + k >= 1) & fits((near + k).cast("double")), near + k) for k in (-1, 0, 1, 2)])
