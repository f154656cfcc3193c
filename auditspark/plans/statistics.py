"""Cluster-aware statistics and sampling under a byte budget."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditspark.functions import stats as S
from auditspark.functions.stats import percent
from auditspark.operators import census as C
from auditspark.operators import sampling as P
from auditspark.operators.quantiles import quantiles
from auditspark.plans.views import Registry, view
from auditspark.session import materialise

r = Registry()
QUERIES, ORACLES = r.queries, r.oracles

Z = S.Z


def idx(spark, sf_dir):
    return view(spark, sf_dir, "idx")


def wilson_sql(k: str, n: str, d: int = 6) -> str:
    mid = f"(({k})::DOUBLE / {n} + {Z * Z} / (2 * {n})) / (1 + {Z * Z} / {n})"
    half = f"({Z} * sqrt(({k})::DOUBLE / {n} * (1 - ({k})::DOUBLE / {n}) / {n} + {Z * Z} / (4.0 * {n} * {n}))) / (1 + {Z * Z} / {n})"
    return f"round(greatest(0, {mid} - {half}), {d}) AS lo, round(least(1, {mid} + {half}), {d}) AS hi"


@r.query("wilson", f"WITH c AS (SELECT class, collection, count(*) AS n, count(*) FILTER (WHERE syntax = 'F') AS k FROM idx GROUP BY ALL) SELECT class, collection, k, n, {wilson_sql('k', 'n')} FROM c")
def wilson(spark, sf_dir):
    """STA1."""
    c = idx(spark, sf_dir).groupBy("class", "collection").agg(F.count("*").alias("n"), F.count_if(F.col("syntax") == "F").alias("k"))
    w = S.wilson(F.col("k"), F.col("n"))
    return c.select("class", "collection", "k", "n", F.round(w["lo"], 6).alias("lo"), F.round(w["hi"], 6).alias("hi"))


@r.query("reporting_rule", "SELECT class, collection, count(*) AS n, CASE WHEN count(*) < 30 THEN 'counts only' WHEN count(*) < 384 THEN 'flagged' ELSE 'rate' END AS rule, CASE WHEN count(*) >= 30 THEN round(100.0 * count(*) FILTER (WHERE syntax = 'F') / count(*), 2) END AS pct FROM idx GROUP BY ALL")
def reporting_rule(spark, sf_dir):
    """STA2."""
    c = idx(spark, sf_dir).groupBy("class", "collection").agg(F.count("*").alias("n"), F.count_if(F.col("syntax") == "F").alias("k"))
    return c.select("class", "collection", "n", S.reporting_rule(F.col("n")).alias("rule"), F.when(F.col("n") >= 30, percent(F.col("k"), F.col("n"))).alias("pct"))


HALVES = [0.05, 0.02, 0.01]


@r.query(
    "smallest_n",
    f"""WITH p AS (SELECT class, avg(CASE WHEN syntax = 'F' THEN 1.0 ELSE 0.0 END) AS p FROM idx GROUP BY class), h AS (SELECT unnest({HALVES}) AS half), g AS (SELECT class, p, half, unnest(range(1, 20001)) AS n FROM p, h)
        SELECT class, half::DOUBLE AS half, round(any_value(p), 6) AS p, min(n) AS smallest_n FROM g WHERE {Z} * sqrt(p * (1 - p) / n + {Z * Z} / (4.0 * n * n)) / (1 + {Z * Z} / n) <= half GROUP BY class, half""",
)
def smallest_n(spark, sf_dir):
    """STA3: the smallest sample whose interval is narrow enough, for each class's own rate and several widths."""
    p = idx(spark, sf_dir).groupBy("class").agg(F.avg(F.when(F.col("syntax") == "F", 1.0).otherwise(0.0)).alias("p"))
    p = p.withColumn("half", F.explode(F.array(*[F.lit(h) for h in HALVES])))
    return p.select("class", "half", F.round("p", 6).alias("p"), S.smallest_n(F.col("p"), F.col("half")).alias("smallest_n"))


@r.query(
    "expected_clusters",
    """WITH s AS (SELECT class, collection, count(*) AS m FROM idx GROUP BY ALL), t AS (SELECT *, sum(m) OVER (PARTITION BY class) AS total FROM s)
       SELECT class, count(*) AS clusters, round(sum(CASE WHEN 60 > total - m THEN 1.0 ELSE 1 - exp(lgamma(total - m + 1) - lgamma(total - m - 60 + 1) - lgamma(total + 1) + lgamma(total - 60 + 1)) END), 4) AS expected FROM t GROUP BY class""",
)
def expected_clusters(spark, sf_dir):
    """STA4: clusters that a simple random sample of 60 meets, exactly."""
    s = idx(spark, sf_dir).groupBy("class", "collection").agg(F.count("*").alias("m"))
    t = s.join(s.groupBy("class").agg(F.sum("m").alias("total")), "class")
    meet = 1 - F.exp(S.log_miss(F.col("m"), F.col("total"), F.lit(60)))
    return t.groupBy("class").agg(F.count("*").alias("clusters"), F.round(F.sum(meet), 4).alias("expected"))


@r.query(
    "expected_clusters_third",
    """WITH s AS (SELECT class, collection, count(*) AS m FROM idx GROUP BY ALL), t AS (SELECT *, sum(m) OVER (PARTITION BY class) AS total, (sum(m) OVER (PARTITION BY class) // 3)::BIGINT AS n FROM s)
       SELECT class, count(*) AS clusters, round(sum(CASE WHEN n > total - m THEN 1.0 ELSE 1 - exp(lgamma(total - m + 1) - lgamma(total - m - n + 1) - lgamma(total + 1) + lgamma(total - n + 1)) END), 4) AS expected FROM t GROUP BY class""",
)
def expected_clusters_third(spark, sf_dir):
    """STA4, for samples that grow with the table: a third of each class."""
    s = idx(spark, sf_dir).groupBy("class", "collection").agg(F.count("*").alias("m"))
    t = s.join(s.groupBy("class").agg(F.sum("m").alias("total")), "class")
    meet = 1 - F.exp(S.log_miss(F.col("m"), F.col("total"), F.floor(F.col("total") / 3)))
    return t.groupBy("class").agg(F.count("*").alias("clusters"), F.round(F.sum(meet), 4).alias("expected"))


ICC_SQL = """c AS (SELECT {k} AS g, {c} AS u, count(y)::DOUBLE AS m, sum(y) AS s, sum(y * y) AS ss FROM d WHERE y IS NOT NULL GROUP BY ALL),
  t AS (SELECT g, count(*)::DOUBLE AS k, sum(m) AS n, sum(s) AS s, sum(ss) AS ss, sum(s * s / m) AS sm, sum(m * m) AS mm FROM c GROUP BY g),
  a AS (SELECT *, (sm - s * s / n) / (k - 1) AS b, (ss - sm) / (n - k) AS w, (n - mm / n) / (k - 1) AS m0 FROM t WHERE k > 1 AND n > k)"""


@r.query("icc", "WITH d AS (SELECT class, collection, CASE WHEN syntax = 'F' OR licence LIKE '%4.0' AND hash_key = 0 THEN 1.0 ELSE 0.0 END AS y FROM (SELECT *, patient % 2 AS hash_key FROM idx)), " + ICC_SQL.format(k="class", c="collection") + " SELECT g AS class, k::BIGINT AS clusters, n::BIGINT AS n, round(m0, 6) AS m0, round((b - w) / (b + (m0 - 1) * w), 6) AS icc FROM a")
def icc(spark, sf_dir):
    """STA5."""
    y = F.when((F.col("syntax") == "F") | (F.endswith("licence", F.lit("4.0")) & (F.col("patient") % 2 == 0)), 1.0).otherwise(0.0)
    out = S.icc(idx(spark, sf_dir).withColumn("y", y), ["class"], "collection", "y")
    return out.select("class", "clusters", "n", F.round("m0", 6).alias("m0"), F.round("icc", 6).alias("icc"))


@r.query("design_effect", "WITH d AS (SELECT class, patient, mb AS y FROM idx), " + ICC_SQL.format(k="class", c="patient") + " SELECT g AS class, round(n / k, 6) AS mean_size, round(1 + (n / k - 1) * ((b - w) / (b + (m0 - 1) * w)), 4) AS deff, round(n / (1 + (n / k - 1) * ((b - w) / (b + (m0 - 1) * w))), 2) AS n_eff FROM a")
def design_effect(spark, sf_dir):
    """STA6: with patients as clusters."""
    t = S.icc(idx(spark, sf_dir), ["class"], "patient", "mb").filter("clusters > 1 AND n > clusters")
    m = F.col("n") / F.col("clusters")
    deff = S.design_effect(m, F.col("icc"))
    return t.select("class", F.round(m, 6).alias("mean_size"), F.round(deff, 4).alias("deff"), F.round(F.col("n") / deff, 2).alias("n_eff"))


@r.query(
    "planning_icc",
    "WITH d AS (SELECT concat(class, '/', proxy) AS class, collection, y FROM (SELECT class, collection, 'syntax' AS proxy, CASE WHEN syntax = 'F' THEN 1.0 ELSE 0.0 END AS y FROM idx UNION ALL SELECT class, collection, 'nc', CASE WHEN licence LIKE '%NC%' THEN 1.0 ELSE 0.0 END FROM idx)), "
    + ICC_SQL.format(k="class", c="collection")
    + " SELECT count(*) AS cells, round(median((b - w) / (b + (m0 - 1) * w)), 6) AS median_icc FROM a",
)
def planning_icc(spark, sf_dir):
    """STA7: the correlation per stratum and proxy, then the exact median."""
    df = idx(spark, sf_dir)
    long = df.select("class", "collection", F.explode(F.array(F.struct(F.lit("syntax").alias("proxy"), F.when(F.col("syntax") == "F", 1.0).otherwise(0.0).alias("y")), F.struct(F.lit("nc").alias("proxy"), F.when(F.contains("licence", F.lit("NC")), 1.0).otherwise(0.0).alias("y")))).alias("p"))
    cells = S.icc(long.select("class", "collection", "p.proxy", "p.y"), ["class", "proxy"], "collection", "y").filter("clusters > 1 AND n > clusters")
    cells = materialise(cells.select("icc"), "cells")
    median = quantiles(cells, [], "icc", {"median_icc": 0.5})
    return cells.agg(F.count("*").alias("cells")).join(median, how="left").select("cells", F.round("median_icc", 6).alias("median_icc"))  # one row each


STRATA = """s AS (SELECT concat(class, ' / ', coalesce(analysis, '(null)')) AS stratum, * FROM idx), u AS (SELECT stratum, collection, count(*) AS n FROM s GROUP BY ALL),
  st AS (SELECT stratum, count(*) AS series, sum(instances)::BIGINT AS instances, sum(mb) AS mb, avg(mb) AS mean_mb, coalesce(stddev_samp(mb), 0) AS sd_mb, count(DISTINCT collection) AS collections, count(DISTINCT patient) AS patients FROM s GROUP BY stratum)"""


def strata_of(spark, sf_dir):
    return P.strata(idx(spark, sf_dir).withColumn("stratum", F.concat_ws(" / ", "class", C.known_id(F.col("analysis")))), "stratum", "mb", "collection", "patient", "instances")


@r.query(
    "strata",
    f"WITH {STRATA} SELECT stratum, series, instances, round(mb, 2) AS mb, round(mean_mb, 4) AS mean_mb, round(sd_mb, 4) AS sd_mb, collections, patients, (SELECT round(100.0 * max(n) / sum(n), 2) FROM u WHERE u.stratum = st.stratum) AS largest_pct, (SELECT string_agg(n, ' ' ORDER BY n DESC) FROM u WHERE u.stratum = st.stratum) AS sizes FROM st",
)
def strata(spark, sf_dir):
    """STA8."""
    s = strata_of(spark, sf_dir)
    return s.select("stratum", "series", "instances", F.round("mb", 2).alias("mb"), F.round("mean_mb", 4).alias("mean_mb"), F.round("sd_mb", 4).alias("sd_mb"), "collections", "patients", F.round("largest_pct", 2).alias("largest_pct"), F.array_join(F.col("sizes").cast("array<string>"), " ").alias("sizes"))


CAP = 20_000_000.0
ALLOC = f"{STRATA}, al AS (SELECT *, CASE WHEN series <= 384 THEN series ELSE least(384, greatest(30, floor({CAP} / mean_mb)::BIGINT)) END AS n FROM st)"


def stratified(spark, sf_dir):
    return idx(spark, sf_dir).withColumn("stratum", F.concat_ws(" / ", "class", C.known_id(F.col("analysis"))))


def allocated(spark, sf_dir):
    return P.allocate_at(strata_of(spark, sf_dir), CAP)


@r.query("allocate", f"WITH {ALLOC} SELECT stratum, series, n, round(n * mean_mb, 2) AS expected_mb, n = series AS whole FROM al")
def allocate(spark, sf_dir):
    """SAM1 at a fixed cap."""
    return allocated(spark, sf_dir).select("stratum", "series", "n", F.round(F.col("n") * F.col("mean_mb"), 2).alias("expected_mb"), (F.col("n") == F.col("series")).alias("whole"))


@r.query(
    "allocate_budget",
    f"""WITH RECURSIVE {STRATA}, sm AS MATERIALIZED (SELECT stratum, series, mean_mb AS m, sd_mb AS sd FROM st), bu AS MATERIALIZED (SELECT 0.4 * sum(mb) AS budget, 384 * max(mean_mb) + 1 AS top FROM st),
        bs AS (SELECT 0 AS step, 0::DOUBLE AS lo, any_value(top)::DOUBLE AS hi FROM bu
          UNION ALL SELECT step + 1, CASE WHEN fits THEN mid ELSE lo END, CASE WHEN fits THEN hi ELSE mid END FROM (
            SELECT step, lo, hi, mid, sum(n * m) + 3 * sqrt(sum(n * sd * sd * (1 - n::DOUBLE / series))) <= any_value(budget) AS fits FROM (
              SELECT bs.step, lo, hi, (lo + hi) / 2 AS mid, m, sd, series, budget, CASE WHEN series <= 384 THEN series ELSE least(384, greatest(30, floor((lo + hi) / 2 / m)::BIGINT)) END AS n FROM bs, sm, bu WHERE step < 200)
            GROUP BY step, lo, hi, mid)),
        mo AS (SELECT sum(n * m) + 3 * sqrt(sum(n * sd * sd * (1 - n::DOUBLE / series))) <= any_value(budget) AS all_fits FROM (SELECT *, least(series, 384) AS n FROM sm), bu),
        ca AS (SELECT CASE WHEN all_fits THEN top ELSE lo END AS cap FROM bs, mo, bu WHERE step = 200)
        SELECT stratum, series, n, round(n * m, 2) AS expected_mb FROM (SELECT *, CASE WHEN series <= 384 THEN series ELSE least(384, greatest(30, floor(cap / m)::BIGINT)) END AS n FROM sm, ca)""",
)
def allocate_budget(spark, sf_dir):
    """SAM1: the cap found by bisection so that the expected size and three deviations stay within the budget."""
    s = strata_of(spark, sf_dir)
    total = s.agg(F.sum("mb")).first()[0] or 0.0
    return P.allocate(s, 0.4 * total)


@r.query(
    "draw",
    f"WITH {ALLOC}, k AS (SELECT stratum, uid, row_number() OVER (PARTITION BY stratum ORDER BY sha256(concat('7|', stratum, '|', CAST(uid AS VARCHAR))), uid) AS place FROM s) SELECT k.stratum, uid, place::INTEGER AS place FROM k JOIN al USING (stratum) WHERE place <= n",
)
def draw(spark, sf_dir):
    """SAM2: a deterministic prefix of each stratum; a larger n only adds."""
    return P.draw(stratified(spark, sf_dir), allocated(spark, sf_dir).select("stratum", "n"), "stratum", "uid", 7)


GATE_STEPS = 120


@r.query(
    "byte_gate",
    f"""WITH {STRATA}, cp AS (SELECT k, {CAP} * pow(0.95, k) AS cap FROM (SELECT unnest(range(0, {GATE_STEPS})) AS k)),
        al AS (SELECT k, cap, st.*, CASE WHEN series <= 384 THEN series ELSE least(384, greatest(30, floor(cap / mean_mb)::BIGINT)) END AS n FROM st, cp),
        rk AS (SELECT stratum, uid, mb, row_number() OVER (PARTITION BY stratum ORDER BY sha256(concat('7|', stratum, '|', CAST(uid AS VARCHAR))), uid) AS place FROM s),
        tt AS (SELECT k, sum(rk.mb) AS drawn FROM al JOIN rk ON rk.stratum = al.stratum AND place <= n GROUP BY k),
        ok AS (SELECT min(k) AS k FROM tt WHERE drawn <= 0.5 * ((SELECT drawn FROM tt WHERE k = 0) + (SELECT drawn FROM tt WHERE k = {GATE_STEPS - 1})))
        SELECT al.stratum, n, al.k::INTEGER AS fired FROM al JOIN ok ON al.k = ok.k""",
)
def byte_gate(spark, sf_dir):
    """SAM3: the cap is shrunk by 5 percent until what is drawn in fact fits the budget (here half-way between the first draw and the least)."""
    df = stratified(spark, sf_dir)
    s = materialise(strata_of(spark, sf_dir), "strata")
    ranked = materialise(P.rank(df, "stratum", "uid", 7, "mb"), "ranked")
    first = P.drawn_size(ranked, P.allocate_at(s, CAP), "stratum", "mb")
    least = P.drawn_size(ranked, P.allocate_at(s, 0.0), "stratum", "mb")
    return P.byte_gate(ranked, s, "stratum", "mb", CAP, 0.5 * (first + least)).select("stratum", "n", "fired")


@r.query(
    "alternatives",
    f"WITH {ALLOC} SELECT 'as allocated' AS plan, sum(n)::BIGINT AS series, round(sum(n * mean_mb), 2) AS mb FROM al UNION ALL SELECT '384 everywhere', sum(least(384, series))::BIGINT, round(sum(least(384, series) * mean_mb), 2) FROM al UNION ALL SELECT 'proportional 10 %', sum(ceil(0.1 * series))::BIGINT, round(sum(ceil(0.1 * series) * mean_mb), 2) FROM al",
)
def alternatives(spark, sf_dir):
    """SAM4: what other allocations cost."""
    a = allocated(spark, sf_dir)
    plans = {"as allocated": F.col("n"), "384 everywhere": F.least(F.lit(384), "series"), "proportional 10 %": F.ceil(F.lit(0.1) * F.col("series")).cast("long")}
    rows = a.select("mean_mb", F.explode(F.array(*[F.struct(F.lit(p).alias("plan"), n.cast("long").alias("n")) for p, n in plans.items()])).alias("x"))
    return rows.groupBy("x.plan").agg(F.sum("x.n").alias("series"), F.round(F.sum(F.col("x.n") * F.col("mean_mb")), 2).alias("mb"))


@r.query(
    "precision",
    f"""WITH {ALLOC}, p AS (SELECT *, n::DOUBLE / least(collections, n) AS m, 1 + (n::DOUBLE / least(collections, n) - 1) * 0.3 AS deff FROM al)
        SELECT stratum, n, round(deff, 4) AS deff, round(n / deff, 2) AS n_eff, round({Z} * sqrt(0.25 / n * (1 - n::DOUBLE / series)), 6) AS half_design, round({Z} * sqrt(0.25 / (n / deff)), 6) AS half_clustered FROM p""",
)
def precision(spark, sf_dir):
    """STA9."""
    a = allocated(spark, sf_dir)
    deff = S.design_effect(F.col("n") / F.least("collections", "n"), F.lit(0.3))
    n = F.col("n")
    return a.select("stratum", "n", F.round(deff, 4).alias("deff"), F.round(n / deff, 2).alias("n_eff"), F.round(Z * F.sqrt(0.25 / n * (1 - n / F.col("series"))), 6).alias("half_design"), F.round(Z * F.sqrt(0.25 / (n / deff)), 6).alias("half_clustered"))


@r.query(
    "prob_any",
    f"""WITH {ALLOC}, k AS (SELECT stratum, count(*) AS marked FROM s WHERE uid % 500 = 7 GROUP BY stratum),
        q AS (SELECT al.*, coalesce(marked, 0) AS marked, CASE WHEN coalesce(marked, 0) = 0 THEN 0 WHEN n > series - marked THEN -1e308 ELSE lgamma(series - marked + 1) - lgamma(series - marked - n + 1) - lgamma(series + 1) + lgamma(series - n + 1) END AS l FROM al LEFT JOIN k USING (stratum))
        SELECT sum(marked)::BIGINT AS n_marked, round(1 - exp(sum(l)), 6) AS probability FROM q""",
)
def prob_any(spark, sf_dir):
    """STA10: the chance that the sample has a marked item."""
    df = idx(spark, sf_dir).withColumn("stratum", F.concat_ws(" / ", "class", C.known_id(F.col("analysis"))))
    k = df.filter("uid % 500 = 7").groupBy("stratum").agg(F.count("*").alias("marked"))
    a = allocated(spark, sf_dir).join(k, "stratum", "left").fillna(0, ["marked"])
    # a finite stand-in for ln 0, so that the sum stays a number
    miss = F.greatest(S.log_miss(F.col("marked"), F.col("series"), F.col("n")), F.lit(-1e6))
    return a.agg(F.sum("marked").alias("n_marked"), F.round(1 - F.exp(F.sum(F.when(F.col("marked") > 0, miss).otherwise(0.0))), 6).alias("probability"))


@r.query(
    "population_rate",
    f"""WITH {ALLOC}, pk AS (SELECT stratum, uid, collection, CASE WHEN licence LIKE '%NC%' THEN 1.0 ELSE 0.0 END AS y, row_number() OVER (PARTITION BY stratum ORDER BY sha256(concat('7|', stratum, '|', CAST(uid AS VARCHAR))), uid) AS place FROM s),
        dr AS (SELECT pk.*, series, n FROM pk JOIN al USING (stratum) WHERE place <= n),
        h AS (SELECT stratum, any_value(series)::DOUBLE AS big, count(*)::DOUBLE AS n, avg(y) AS p, coalesce(var_samp(y), 0) AS v, count(DISTINCT collection) AS psus FROM dr GROUP BY stratum),
        tot AS (SELECT sum(big) AS w, sum(big * p) / sum(big) AS rate, sum(big * big * (1 - n / big) * v / n) AS vd FROM h),
        z AS (SELECT dr.stratum, collection, CASE WHEN psus = 1 THEN '(single)' ELSE dr.stratum END AS vs, sum(big / h.n * (y - rate)) AS e FROM dr JOIN h USING (stratum), tot GROUP BY ALL),
        hv AS (SELECT CASE WHEN psus = 1 THEN '(single)' ELSE stratum END AS vs, sum(n) / sum(big) AS f FROM h GROUP BY 1),
        vv AS (SELECT vs, count(*) AS k, sum(e) AS s, sum(e * e) AS ss FROM z GROUP BY vs)
        SELECT (SELECT count(*) FROM dr) AS n, round(100 * any_value(rate), 4) AS pct, round(100 * sqrt(any_value(vd)) / any_value(w), 6) AS se_design,
               round(100 * sqrt(sum(CASE WHEN k > 1 THEN (1 - f) * k / (k - 1.0) * (ss - s * s / k) ELSE 0 END)) / any_value(w), 6) AS se_clustered, (sum(k) - count(*))::BIGINT AS df FROM vv JOIN hv USING (vs), tot""",
)
def population_rate(spark, sf_dir):
    """STA11: the weighted rate with its design and clustered standard errors; strata with one cluster are one for
    the variance."""
    df = stratified(spark, sf_dir).withColumn("y", F.when(F.contains("licence", F.lit("NC")), 1.0).otherwise(0.0))
    s = materialise(strata_of(spark, sf_dir), "strata")
    sample = materialise(P.drawn(P.rank(df, "stratum", "uid", 7, "collection", "y"), P.allocate_at(s, CAP), "stratum"), "sample")
    return P.population_rate(sample, s.select("stratum", "series"), "stratum", "collection", "y")


@r.query(
    "leave_one_out",
    """WITH u AS (SELECT collection, count(*) AS n, count(*) FILTER (WHERE syntax = 'F') AS k FROM idx GROUP BY collection), t AS (SELECT sum(n) AS nn, sum(k) AS kk FROM u)
       SELECT collection, n, k, round(100.0 * (kk - k) / (nn - n), 4) AS pct_without, round(100.0 * (kk - k) / (nn - n) - 100.0 * kk / nn, 4) AS shift FROM u, t QUALIFY row_number() OVER (ORDER BY n DESC, collection) <= 5""",
)
def leave_one_out(spark, sf_dir):
    """STA12: the five largest units."""
    u = idx(spark, sf_dir).groupBy("collection").agg(F.count("*").alias("n"), F.count_if(F.col("syntax") == "F").alias("k"))
    t = u.agg(F.sum("n").alias("nn"), F.sum("k").alias("kk"))
    j = u.orderBy(F.desc("n"), "collection").limit(5).join(t)
    without = 100.0 * (F.col("kk") - F.col("k")) / (F.col("nn") - F.col("n"))
    return j.select("collection", "n", "k", F.round(without, 4).alias("pct_without"), F.round(without - 100.0 * F.col("kk") / F.col("nn"), 4).alias("shift"))


@r.query(
    "cluster_summary",
    """WITH u AS (SELECT class, collection, count(*) AS n, count(*) FILTER (WHERE coalesce(trim(maker), '') = '') AS k FROM idx GROUP BY ALL)
       SELECT class, round(100.0 * sum(k) / sum(n), 4) AS pct, round(quantile_cont(100.0 * k / n, 0.25), 4) AS q1, round(median(100.0 * k / n), 4) AS q2, round(quantile_cont(100.0 * k / n, 0.75), 4) AS q3,
         count(*) FILTER (WHERE k = 0) AS at_0, count(*) FILTER (WHERE k = n) AS at_100, round(100.0 * max(n) / sum(n), 4) AS largest_share, arg_max(collection, n * 1000 - CAST(substr(collection, 8) AS BIGINT)) AS largest FROM u GROUP BY class""",
)
def cluster_summary(spark, sf_dir):
    """STA13: boundary counts are exact, not of rounded shares."""
    u = idx(spark, sf_dir).groupBy("class", "collection").agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.trim("maker"), F.lit("")) == "").alias("k"))
    u = materialise(u.withColumn("share", 100.0 * F.col("k") / F.col("n")), "clusters")
    q = quantiles(u, ["class"], "share", {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    t = u.groupBy("class").agg(percent(F.sum("k"), F.sum("n"), 4).alias("pct"), F.count_if(F.col("k") == 0).alias("at_0"), F.count_if(F.col("k") == F.col("n")).alias("at_100"), percent(F.max("n"), F.sum("n"), 4).alias("largest_share"), F.max_by("collection", F.struct("n", -F.substr("collection", F.lit(8)).cast("int"))).alias("largest"))
    return t.join(q, "class").select("class", "pct", *[F.round(c, 4).alias(c) for c in ("q1", "q2", "q3")], "at_0", "at_100", "largest_share", "largest")


@r.query(
    "seg_intervals",
    f"WITH c AS (SELECT identification, count(*) AS k, count(DISTINCT uid) AS units FROM seg WHERE non_manual GROUP BY 1), t AS (SELECT *, (SELECT count(*) FROM seg WHERE non_manual) AS n FROM c) SELECT identification, k, n, units, {wilson_sql('k', 'n')} FROM t",
)
def seg_intervals(spark, sf_dir):
    """STA14."""
    s = view(spark, sf_dir, "seg").filter("non_manual")
    c = s.groupBy("identification").agg(F.count("*").alias("k"), F.count_distinct("uid").alias("units")).join(s.agg(F.count("*").alias("n")))
    w = S.wilson(F.col("k"), F.col("n"))
    return c.select("identification", "k", "n", "units", F.round(w["lo"], 6).alias("lo"), F.round(w["hi"], 6).alias("hi"))
