"""The claims table: sticky upserts, validation, references and what quotes what."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from auditspark.functions.stats import percent
from auditspark.operators import claims as G
from auditspark.operators import records as L
from auditspark.plans.views import Registry, view
from auditspark.session import read_table, scratch_path
from auditspark.sources import buckets as B

r = Registry()
QUERIES, ORACLES = r.queries, r.oracles

STATUSES = ["MEASURED", "VERIFIED", "DERIVED", "PENDING", "LITERATURE", "RETIRED"]


def claim(spark, sf_dir):
    return view(spark, sf_dir, "claim")


def proposals(spark, sf_dir):
    p = read_table(spark, sf_dir, "part").filter("p_partkey % 7 < 3")
    return p.select(
        F.concat(F.lit("C-"), (F.col("p_partkey") * 2).cast("string")).alias("id"), F.lit("new").alias("section"), F.concat(F.lit("revised "), "p_name").alias("claim"), F.when(F.col("p_partkey") % 2 == 0, "MEASURED").otherwise("BOGUS").alias("status")
    )


PROP = "p AS (SELECT concat('C-', p_partkey * 2) AS id, 'new' AS section, concat('revised ', p_name) AS claim, CASE WHEN p_partkey % 2 = 0 THEN 'MEASURED' ELSE 'BOGUS' END AS status FROM part WHERE p_partkey % 7 < 3)"


@r.query(
    "sticky_upsert",
    f"""WITH {PROP}, o AS (SELECT id, section, claim, status FROM claim), q AS (SELECT * FROM p WHERE status <> 'BOGUS')
        SELECT id, coalesce(q.section, o.section) AS section, coalesce(q.claim, o.claim) AS claim, CASE WHEN o.status = 'RETIRED' THEN 'RETIRED' ELSE coalesce(q.status, o.status) END AS status FROM o FULL JOIN q USING (id)""",
)
def sticky_upsert(spark, sf_dir):
    """GOV1: a retirement survives a re-run."""
    new = proposals(spark, sf_dir).filter("status <> 'BOGUS'")
    return G.sticky_upsert(claim(spark, sf_dir).select("id", "section", "claim", "status"), new, "id", {"status": "RETIRED"})


@r.query(
    "bucketed_upsert",
    f"""WITH {PROP}, o AS (SELECT id, section, claim, status FROM claim), q AS (SELECT * FROM p WHERE status <> 'BOGUS'),
        t AS (SELECT id, coalesce(q.section, o.section) AS section, coalesce(q.claim, o.claim) AS claim, CASE WHEN o.status = 'RETIRED' THEN 'RETIRED' ELSE coalesce(q.status, o.status) END AS status FROM o FULL JOIN q USING (id))
        SELECT id, section, claim, CASE WHEN status = 'RETIRED' OR CAST(substr(id, 3) AS BIGINT) % 3 > 0 THEN status ELSE 'RETIRED' END AS status FROM t""",
)
def bucketed_upsert(spark, sf_dir):
    """GOV1 over a table in buckets: two batches, of which the second retires a third of all ids."""
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name, path = f"claims_{uuid.uuid4().hex[:8]}", scratch_path(spark, "claims")
    B.create(claim(spark, sf_dir).select("id", "section", "claim", "status"), name, "id", buckets, path)
    new = proposals(spark, sf_dir).filter("status <> 'BOGUS'")
    B.change(spark, name, "id", buckets, path, lambda old: G.sticky_upsert(old, new, "id", {"status": "RETIRED"}))
    third = B.read(spark, name).filter(F.substr("id", F.lit(3)).cast("long") % 3 == 0).select("id", *[F.lit(None).cast("string").alias(c) for c in ("section", "claim")], F.lit("RETIRED").alias("status"))
    B.change(spark, name, "id", buckets, path, lambda old: G.sticky_upsert(old, third, "id", {"status": "RETIRED"}))
    return B.read(spark, name)


@r.query("bucketed_pending", "SELECT o_orderkey AS uid FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity < 10)")
def bucketed_pending(spark, sf_dir):
    """SRC9 over a plan and a log in buckets of one key: neither moves."""
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan, log = (f"{t}_{uuid.uuid4().hex[:8]}" for t in ("plan", "log"))
    B.create(read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("uid")), plan, "uid", buckets, scratch_path(spark, "plan"))
    B.create(read_table(spark, sf_dir, "lineitem").filter("l_quantity < 10").select(F.col("l_orderkey").alias("uid")), log, "uid", buckets, scratch_path(spark, "log"))
    return L.pending(B.read(spark, plan), B.read(spark, log), "uid")


@r.query(
    "sticky_outcome",
    f"""WITH {PROP}, o AS (SELECT CASE WHEN CAST(substr(id, 3) AS BIGINT) % 5 = 0 THEN concat('PRE-', id) ELSE id END AS id, section, claim, status FROM claim), q AS (SELECT CASE WHEN CAST(substr(id, 3) AS BIGINT) % 5 = 0 THEN concat('PRE-', id) ELSE id END AS id, section, claim, status FROM p WHERE status <> 'BOGUS')
        SELECT id, coalesce(q.section, o.section) AS section, CASE WHEN id LIKE 'PRE-%' AND o.id IS NOT NULL THEN o.claim ELSE coalesce(q.claim, o.claim) END AS claim, CASE WHEN o.status = 'RETIRED' THEN 'RETIRED' ELSE coalesce(q.status, o.status) END AS status FROM o FULL JOIN q USING (id)""",
)
def sticky_outcome(spark, sf_dir):
    """GOV1: pre-registered rows keep their outcome fields unless an outcome is written."""
    pre = F.when(F.substr("id", F.lit(3)).cast("long") % 5 == 0, F.concat(F.lit("PRE-"), "id")).otherwise(F.col("id"))
    new = proposals(spark, sf_dir).filter("status <> 'BOGUS'").withColumn("id", pre)
    return G.sticky_upsert(claim(spark, sf_dir).select(pre.alias("id"), "section", "claim", "status"), new, "id", {"status": "RETIRED"}, protected=(F.startswith("id", F.lit("PRE-")), ["claim"]))


FIELDS = ["id", "section", "claim", "status"]
UNKNOWN = "list_concat(CASE WHEN p_partkey % 4 = 0 THEN ['note'] ELSE [] END, CASE WHEN p_partkey % 8 = 0 THEN ['seen_by'] ELSE [] END)"
#: what the files of proposed() hold, row by row
FILED = f"p AS (SELECT p_partkey // 50 AS file, concat('C-', p_partkey * 2) AS id, CASE WHEN p_partkey % 11 <> 0 THEN 'new' END AS section, CASE WHEN p_partkey % 3 > 0 THEN concat('revised ', p_name) END AS claim, CASE WHEN p_partkey % 5 > 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'MEASURED' ELSE 'BOGUS' END END AS status, {UNKNOWN} AS unknown FROM part)"


def proposed(spark, sf_dir):
    """Rows out of proposal files, each about 50 parts long: lists and envelopes in turn."""
    k = F.col("p_partkey")
    row = F.struct(
        F.concat(F.lit("C-"), (k * 2).cast("string")).alias("id"), F.when(k % 11 != 0, "new").alias("section"), F.when(k % 3 > 0, F.concat(F.lit("revised "), "p_name")).alias("claim"),
        F.when(k % 5 > 0, F.when(k % 2 == 0, "MEASURED").otherwise("BOGUS")).alias("status"), F.when(k % 4 == 0, "why").alias("note"), F.when(k % 8 == 0, F.lit(3)).alias("seen_by"),
    )
    files = read_table(spark, sf_dir, "part").groupBy(F.expr("p_partkey DIV 50").alias("file")).agg(F.collect_list(row).alias("rows"))
    content = F.when(F.col("file") % 2 == 0, F.to_json("rows")).otherwise(F.to_json(F.struct(F.lit("a run").alias("track"), "rows")))
    return G.proposed_rows(files.select("file", content.alias("content")), "file", "content", FIELDS)


STATUS_SQL = ", ".join(f"'{s}'" for s in STATUSES)


@r.query(
    "validate_rows",
    f"""WITH {FILED}, q AS (SELECT CASE WHEN file % 3 = 0 THEN 'C-' || file ELSE id END AS id, section, claim, status, unknown FROM p)
        SELECT id, 'invalid status' AS violation FROM q WHERE status NOT IN ({STATUS_SQL}) UNION ALL SELECT id, 'duplicate id' FROM q GROUP BY id HAVING count(*) > 1
        UNION ALL SELECT id, concat('unknown field ', unnest(unknown)) FROM q {" ".join(f"UNION ALL SELECT id, 'missing {c}' FROM q WHERE {c} IS NULL" for c in ("section", "claim", "status"))}""",
)
def validate_rows(spark, sf_dir):
    """GOV2: all violations of a batch."""
    rows = proposed(spark, sf_dir).withColumn("id", F.when(F.col("file") % 3 == 0, F.concat(F.lit("C-"), F.col("file").cast("string"))).otherwise(F.col("id")))
    return G.violations(rows, "id", STATUSES, ["section", "claim", "status"], F.col("unknown"))


@r.query(
    "record_many",
    """WITH o AS (SELECT id, section, claim, status FROM claim), q AS (SELECT concat('C-', p_partkey * 2) AS id, 'new' AS section, concat('revised ', p_name) AS claim, 'MEASURED' AS status FROM part WHERE p_partkey % 7 < 3 AND p_partkey % 2 = 0)
       SELECT id, coalesce(q.section, o.section) AS section, coalesce(q.claim, o.claim) AS claim, CASE WHEN o.status = 'RETIRED' THEN 'RETIRED' ELSE coalesce(q.status, o.status) END AS status FROM o FULL JOIN q USING (id)""",
)
def record_many(spark, sf_dir):
    """GOV2: a batch goes in as a whole or not at all. The first has no fault, the second has some."""
    table = claim(spark, sf_dir).select(*FIELDS)
    p = proposals(spark, sf_dir)
    for batch in (p.filter("status <> 'BOGUS'"), p.withColumn("section", F.lit("later"))):
        rows = G.all_or_nothing(batch, G.violations(batch, "id", STATUSES, ["section", "claim", "status"]))
        table = G.sticky_upsert(table, rows, "id", {"status": "RETIRED"})
    return table


@r.query(
    "retire",
    """WITH x AS (SELECT concat('C-', p_partkey) AS id, concat('C-', p_partkey + 1) AS successor FROM part WHERE p_partkey % 50 = 1)
       SELECT c.id, CASE WHEN a.id IS NOT NULL THEN 'RETIRED' ELSE status END AS status, coalesce(a.successor, superseded_by) AS superseded_by, b.id AS supersedes FROM claim c LEFT JOIN x a ON a.id = c.id LEFT JOIN x b ON b.successor = c.id""",
)
def retire(spark, sf_dir):
    """GOV3."""
    x = read_table(spark, sf_dir, "part").filter("p_partkey % 50 = 1").select(F.concat(F.lit("C-"), F.col("p_partkey").cast("string")).alias("id"), F.concat(F.lit("C-"), (F.col("p_partkey") + 1).cast("string")).alias("successor"))
    return G.retire(claim(spark, sf_dir).select("id", "status", "superseded_by"), x)


@r.query("rates_without_floor", "SELECT id, claim FROM claim WHERE status = 'MEASURED' AND (contains(claim, 'percent') OR contains(claim, '%') OR contains(claim, ' of ')) AND coalesce(trim(floor_value), '') = ''")
def rates_without_floor(spark, sf_dir):
    """GOV4."""
    return G.rates_without_floor(claim(spark, sf_dir), "claim", "floor_value").select("id", "claim")


COLS = ["id", "section", "claim", "status", "floor_value", "sources", "derived_from", "superseded_by"]


@r.query("fill_rates", " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE trim({c}) <> '') AS filled, round(100.0 * count(*) FILTER (WHERE trim({c}) <> '') / count(*), 1) AS pct FROM claim" for c in COLS))
def fill_rates(spark, sf_dir):
    """GOV5: one pass over all columns."""
    return G.fill_rates(claim(spark, sf_dir).select(*COLS))


@r.query("null_join_guard", "SELECT count(*) AS n_rows, count(*) FILTER (WHERE maker IS NULL) AS null_maker, count(*) FILTER (WHERE model IS NULL) AS null_model, count(*) FILTER (WHERE maker IS NULL OR model IS NULL) AS any_null, count(*) FILTER (WHERE maker IS NULL OR model IS NULL) = 0 AS clean FROM idx")
def null_join_guard(spark, sf_dir):
    """GOV6."""
    return G.null_join_guard(view(spark, sf_dir, "idx"), ["maker", "model"])


@r.query(
    "merge_proposals",
    f"""WITH {FILED}, j AS (SELECT p.*, c.claim AS old_claim, c.status AS old_status, c.id IS NOT NULL AS there, substr(p.id, 1, 3) = 'C-7' AS protected FROM p LEFT JOIN claim c USING (id)),
        d AS (SELECT *, list_filter([CASE WHEN status NOT IN ({STATUS_SQL}) THEN 'invalid status' END, CASE WHEN protected AND NOT there THEN 'new pre-registration' END, CASE WHEN protected AND there AND claim <> old_claim THEN 'rewords a protected row' END,
            CASE WHEN protected AND there AND section IS NOT NULL THEN 'sets section' END, CASE WHEN old_status = 'RETIRED' AND status <> 'RETIRED' THEN 'un-retires' END, CASE WHEN old_status = 'RETIRED' AND claim <> old_claim THEN 'rewords a retired row' END], lambda x: x IS NOT NULL) AS why FROM j)
        SELECT file, id, claim, status, len(unknown)::INTEGER AS dropped, CASE WHEN len(why) = 0 THEN 'accepted' ELSE array_to_string(why, '; ') END AS decision FROM d""",
)
def merge_proposals(spark, sf_dir):
    """GOV7: the rows of all proposal files, without foreign keys, and what speaks against each."""
    judged = G.judge_proposals(proposed(spark, sf_dir), claim(spark, sf_dir), STATUSES, F.startswith("id", F.lit("C-7")), ["claim", "status"])
    return judged.select("file", "id", "claim", "status", "dropped", "decision")


SRC = "t AS (SELECT id, unnest(list_filter(list_transform(regexp_split_to_array(sources, ' and |,'), lambda x: trim(x)), lambda x: x <> '')) AS token FROM claim), k AS (SELECT DISTINCT source FROM documents)"
REF = "rf AS (SELECT id, unnest(list_filter(list_transform(string_split(derived_from, ','), lambda x: trim(x)), lambda x: x <> '')) AS ref FROM claim)"


def tokens(spark, sf_dir):
    return G.tokens(claim(spark, sf_dir), "id", "sources", " and |,", "token")


def refs(spark, sf_dir):
    return G.tokens(claim(spark, sf_dir), "id", "derived_from", ",", "ref")


@r.query(
    "claims_join",
    f"""WITH {SRC}, {REF}, s AS (SELECT id, count(*) AS n, count(k.source) AS found, string_agg(k.source, ' ' ORDER BY k.source) AS carried_by FROM t LEFT JOIN k ON k.source = t.token GROUP BY id),
        q AS (SELECT rf.id, bool_and(c.id IS NOT NULL) AS refs_ok FROM rf LEFT JOIN claim c ON c.id = rf.ref GROUP BY rf.id)
        SELECT c.id, CASE WHEN n IS NULL THEN 'none' WHEN found = n THEN 'yes' WHEN found > 0 THEN 'partial' ELSE 'no' END AS source_exists, carried_by, coalesce(refs_ok, true) AS refs_ok, c.superseded_by IS NULL OR u.id IS NOT NULL AS successor_ok
        FROM claim c LEFT JOIN s USING (id) LEFT JOIN q USING (id) LEFT JOIN claim u ON u.id = c.superseded_by""",
)
def claims_join(spark, sf_dir):
    """GOV8: a row for each claim with what became of its sources and references."""
    return G.claims_join(claim(spark, sf_dir), tokens(spark, sf_dir), refs(spark, sf_dir), read_table(spark, sf_dir, "documents").select(F.col("source").alias("artefact")).distinct())


@r.query(
    "whole_token_mentions",
    """WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9-]+')) AS token FROM documents), i AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS id FROM part UNION SELECT 'the' UNION SELECT 'idiot')
       SELECT id, count(*) AS documents FROM i JOIN w ON w.token = i.id GROUP BY id""",
)
def whole_token_mentions(spark, sf_dir):
    """GOV9: documents are cut to tokens once, and the ids join on equality; no pattern per pair."""
    ids = read_table(spark, sf_dir, "part").select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("id")).union(spark.range(1).select(F.explode(F.array(F.lit("the"), F.lit("idiot"))))).distinct()
    return G.mentions(read_table(spark, sf_dir, "documents"), "doc_id", F.lower("text"), ids).groupBy("id").agg(F.count("*").alias("documents"))


@r.query("orphans", f"WITH {SRC} SELECT c.id FROM claim c WHERE c.id NOT IN (SELECT t.id FROM t JOIN k ON k.source = t.token)")
def orphans(spark, sf_dir):
    """GOV10: claims without any artefact."""
    known = read_table(spark, sf_dir, "documents").select(F.col("source").alias("token")).distinct()
    return claim(spark, sf_dir).select("id").join(tokens(spark, sf_dir).join(known, "token"), "id", "left_anti")


@r.query("uncited", f"WITH {SRC} SELECT source AS artefact FROM k WHERE source NOT IN (SELECT token FROM t WHERE id NOT IN ('C-1', 'C-31', 'C-61'))")
def uncited(spark, sf_dir):
    """GOV10: artefacts that no claim names."""
    named = tokens(spark, sf_dir).filter(~F.col("id").isin("C-1", "C-31", "C-61")).select(F.col("token").alias("artefact"))
    return read_table(spark, sf_dir, "documents").select(F.col("source").alias("artefact")).distinct().join(named, "artefact", "left_anti")


@r.query("broken_refs", f"WITH {REF} SELECT id, ref FROM rf WHERE ref NOT IN (SELECT id FROM claim)")
def broken_refs(spark, sf_dir):
    """GOV11."""
    return refs(spark, sf_dir).join(claim(spark, sf_dir).select(F.col("id").alias("ref")), "ref", "left_anti").select("id", "ref")


@r.query("supersession", "SELECT c.id, c.superseded_by, CASE WHEN c.superseded_by IS NULL THEN 'no successor' WHEN u.id IS NULL THEN 'missing' WHEN u.status = 'RETIRED' THEN 'retired too' ELSE 'current' END AS state FROM claim c LEFT JOIN claim u ON u.id = c.superseded_by WHERE c.status = 'RETIRED'")
def supersession(spark, sf_dir):
    """GOV12, one hop."""
    c = claim(spark, sf_dir)
    u = c.select(F.col("id").alias("uid"), F.col("status").alias("ustatus"))
    state = F.when(F.col("superseded_by").isNull(), "no successor").when(F.col("uid").isNull(), "missing").when(F.col("ustatus") == "RETIRED", "retired too").otherwise("current")
    return c.filter("status = 'RETIRED'").join(u, F.col("uid") == F.col("superseded_by"), "left").select("id", "superseded_by", state.alias("state"))


@r.query(
    "supersession_chains",
    "WITH RECURSIVE e AS (SELECT id, superseded_by FROM claim), t AS (SELECT id, superseded_by AS nxt, 1 AS hops FROM e WHERE superseded_by IS NOT NULL UNION ALL SELECT t.id, e.superseded_by, t.hops + 1 FROM t JOIN e ON e.id = t.nxt WHERE e.superseded_by IS NOT NULL) SELECT id, arg_max(nxt, hops) AS last, max(hops)::BIGINT AS hops FROM t GROUP BY id",
)
def supersession_chains(spark, sf_dir):
    """GOV12, whole chains, of any length."""
    return G.chain_ends(claim(spark, sf_dir).select("id", F.col("superseded_by").alias("next")))


@r.query("outcomes", f"WITH {PROP} SELECT c.id, CASE WHEN coalesce(trim(floor_value), '') <> '' THEN 'recorded' WHEN q.id IS NOT NULL THEN 'proposed' ELSE 'open' END AS outcome FROM claim c LEFT JOIN (SELECT DISTINCT id FROM p) q USING (id) WHERE c.status = 'PENDING'")
def outcomes(spark, sf_dir):
    """GOV13."""
    q = proposals(spark, sf_dir).select("id", F.lit(True).alias("q")).distinct()
    what = F.when(F.coalesce(F.trim("floor_value"), F.lit("")) != "", "recorded").when(F.col("q"), "proposed").otherwise("open")
    return claim(spark, sf_dir).filter("status = 'PENDING'").join(q, "id", "left").select("id", what.alias("outcome"))


@r.query("status_summary", "SELECT status, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM claim), 2) AS pct FROM claim GROUP BY status")
def status_summary(spark, sf_dir):
    """GOV14."""
    n = claim(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))
    return n.join(n.agg(F.sum("n").alias("all"))).select("status", "n", percent(F.col("n"), F.col("all")).alias("pct"))
