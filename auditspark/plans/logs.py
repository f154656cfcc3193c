"""Reading, writing and streaming of record logs. Each query writes data of the given tables to the shared folder
and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditspark.plans.messages import KEPT
from auditspark.plans.views import Registry, view
from auditspark.session import read_table, scratch_path
from auditspark.sources import guarded, jsonl, tables
from auditspark.streaming import records as S

r = Registry()
QUERIES, ORACLES = r.queries, r.oracles

SCHEMA = T.StructType([T.StructField("uid", T.LongType()), T.StructField("status", T.StringType()), T.StructField("objects", T.ArrayType(T.StructType([T.StructField("n", T.LongType()), T.StructField("v", T.DoubleType())])))])


def log_file(spark, sf_dir):
    """events as JSONL with blank, broken and misshapen lines among them."""
    e = read_table(spark, sf_dir, "events")
    good = F.to_json(F.struct(F.col("user_id").alias("uid"), F.when(F.col("event_type") == "error", "FETCH_FAILED").otherwise("OK").alias("status"), F.array(F.struct(F.col("event_id").alias("n"), F.col("value").alias("v"))).alias("objects")))
    k = F.col("event_id") % 20
    line = F.when(k == 3, F.lit("   ")).when(k == 7, F.substring(good, 1, 25)).when(k == 11, F.lit('{"other": 1}')).otherwise(good)
    path = scratch_path(spark, "log")
    e.select(line.alias("value")).write.text(path)
    return path


@r.query(
    "scan_records",
    "SELECT count(*) FILTER (WHERE event_id % 20 <> 3) AS lines_seen, count(*) FILTER (WHERE event_id % 20 = 7) AS unparsable, count(*) FILTER (WHERE event_id % 20 = 11) AS wrong_shape, count(*) FILTER (WHERE event_id % 20 NOT IN (3, 7, 11)) AS records, count(DISTINCT user_id) FILTER (WHERE event_id % 20 NOT IN (3, 7, 11)) AS keys, count(*) FILTER (WHERE event_id % 20 NOT IN (3, 7, 11) AND event_type <> 'error') AS objects FROM events",
)
def scan_records(spark, sf_dir):
    """SRC2: bad lines are skipped and counted."""
    lines = jsonl.read_lines(spark, log_file(spark, sf_dir), SCHEMA, "uid")
    ok = F.col("problem").isNull()
    n = [F.count("*").alias("lines_seen"), F.count_if(F.col("problem") == "unparsable").alias("unparsable"), F.count_if(F.col("problem") == "wrong shape").alias("wrong_shape")]
    return lines.agg(*n, F.count_if(ok).alias("records"), F.count_distinct(F.when(ok, F.col("uid"))).alias("keys"), F.coalesce(F.sum(F.when(ok & (F.col("status") == "OK"), F.size("objects"))), F.lit(0)).alias("objects"))


@r.query("write_table", "SELECT kind, count(*) AS n, sum(length(url)) :: BIGINT AS chars, count(url) AS urls FROM (SELECT CASE WHEN page_id % 10 = 0 THEN NULL ELSE concat(url, chr(10), '\"x\",') END AS url FROM pages), (SELECT unnest(['csv', 'json', 'parquet']) AS kind) GROUP BY kind")
def write_table(spark, sf_dir):
    """SRC12: written three ways and read back whole, with quotes, line ends and nulls."""
    p = read_table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 10 != 0, F.concat("url", F.lit('\n"x",'))).alias("url"))
    out = None
    for kind in ("csv", "json", "parquet"):
        path = scratch_path(spark, kind)
        tables.write_table(p, path, kind)
        back = tables.read_csv(spark, path, "page_id long, url string") if kind == "csv" else spark.read.schema(p.schema).format(kind).load(path)
        n = back.agg(F.count("*").alias("n"), F.sum(F.length("url")).alias("chars"), F.count("url").alias("urls")).withColumn("kind", F.lit(kind))
        out = n if out is None else out.unionByName(n)
    return out


@r.query("atomic_publish", "SELECT count(*) AS n, true AS published, false AS replaced FROM orders")
def atomic_publish(spark, sf_dir):
    """SRC13: a partial table does not replace a good one."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey")
    path = scratch_path(spark, "orders")
    n = o.count()
    first = tables.publish(o, path, n)
    second = tables.publish(o.filter("o_orderkey % 2 = 0"), path, n)
    return tables.published(spark, path).agg(F.count("*").alias("n")).select("n", F.lit(first).alias("published"), F.lit(second).alias("replaced"))


@r.query("guarded_publish", "SELECT o_orderkey AS uid, o_totalprice AS price, true AS refused FROM orders")
def guarded_publish(spark, sf_dir):
    """SRC12, SRC13 as a data source: a write that is too short is refused, and the whole table is read back."""
    guarded.register(spark)
    o = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("uid"), F.col("o_totalprice").alias("price"))
    path = scratch_path(spark, "guarded")
    write = lambda df: df.write.format("guarded").option("at_least", n).mode("append").save(path)
    n = o.count()
    write(o)
    try:
        write(o.filter("uid % 2 = 0"))
        refused = False
    except Exception as e:
        if "the table needs" not in str(e):
            raise
        refused = True
    return spark.read.format("guarded").load(path).withColumn("refused", F.lit(refused))


@r.query(
    "stream_records",
    f"""WITH {KEPT} SELECT b.uid, b.ordinal, b.status = 'OK' AS kept_ok, b.outcome, count(*) AS attempts, count(*) FILTER (WHERE a.status <> 'OK') AS failures, count(*) - 1 AS duplicates,
        count(*) FILTER (WHERE a.status = 'OK' AND b.status = 'OK' AND a.outcome <> b.outcome) AS disagreements FROM b JOIN a USING (uid) GROUP BY ALL""",
)
def stream_records(spark, sf_dir):
    """STR1: the log arrives in files; the merged state equals the batch merge."""
    log, state, mark = (scratch_path(spark, n) for n in ("log", "state", "checkpoint"))
    rows = view(spark, sf_dir, "attempt")
    rows.repartition(3, "ordinal").write.json(log)
    S.stream_records(spark, log, rows.schema, state, mark, "uid", "ordinal", F.col("status") == "OK", ["outcome"]).awaitTermination()
    return S.current(spark, state, "uid", "ordinal")
