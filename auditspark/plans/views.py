"""The roles that the given tables play (an archive's index, its objects, segments, messages, logs, claims),
as views in SQL that both engines read: view(spark, sf_dir, NAME) for Spark, with_views(sql) for the oracle.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from auditspark.session import read_table

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: View -> SQL over tables and views before it.
VIEWS = {
    # one row for each series
    "idx": """
        SELECT o.o_orderkey AS uid, o.o_custkey AS patient, o.o_orderpriority AS class, o.o_orderstatus AS syntax,
               n.n_name AS collection, CASE WHEN c.c_mktsegment = 'BUILDING' THEN NULL ELSE c.c_mktsegment END AS analysis,
               CAST(o.o_orderkey % 5 + 1 AS BIGINT) AS instances, o.o_totalprice AS mb,
               CASE o.o_orderkey % 4 WHEN 0 THEN 'CC BY 3.0' WHEN 1 THEN 'CC BY 4.0' WHEN 2 THEN 'CC BY-NC 3.0' ELSE 'CC BY-NC 4.0' END AS licence,
               CASE WHEN o.o_orderkey % 13 = 0 THEN NULL WHEN o.o_orderkey % 13 = 1 THEN '' WHEN o.o_orderkey % 13 = 2 THEN 'N/A' ELSE p.p_name END AS maker,
               CASE WHEN o.o_orderkey % 17 = 0 THEN NULL WHEN o.o_orderkey % 17 = 1 THEN ' ' ELSE concat(p.p_brand, ' v', CAST(p.p_size AS VARCHAR(9)), '.', CAST(o.o_orderkey % 3 AS VARCHAR(9))) END AS model,
               CASE WHEN o.o_orderkey % 7 = 0 THEN NULL ELSE concat(p.p_type, ' ', p.p_name, ' of ', n.n_name) END AS description,
               concat('10.', CAST(o.o_custkey % 50 AS VARCHAR(9)), '/', n.n_name) AS doi
        FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
        LEFT JOIN part p ON p.p_partkey = o.o_orderkey % (SELECT count(*) FROM part)""",
    # one row for each segment of an object (an order's lines)
    "seg": """
        SELECT l.l_orderkey AS uid, l.l_linenumber AS number, l.l_partkey AS part, l.l_returnflag AS kind, l.l_linestatus AS line_status,
               l.l_extendedprice AS price, l.l_quantity AS quantity,
               CASE WHEN l.l_quantity < 10 THEN NULL WHEN l.l_quantity < 15 THEN '' ELSE concat('tool ', CAST(l.l_suppkey % 7 AS VARCHAR(9))) END AS tool,
               CASE WHEN l.l_discount < 0.03 THEN NULL WHEN l.l_discount < 0.05 THEN '' ELSE concat('v', CAST(l.l_linenumber AS VARCHAR(9)), '.1') END AS tool_version,
               CASE WHEN l.l_tax < 0.02 THEN 'absent' WHEN l.l_tax < 0.04 THEN 'present_zero_items' WHEN l.l_tax < 0.06 THEN 'present_incomplete' ELSE 'present_complete' END AS identification,
               l.l_returnflag <> 'R' AS non_manual
        FROM lineitem l""",
    # validator messages: one row for each line that a validator wrote about an object
    "msg": """
        SELECT e.event_id AS line, e.user_id AS uid, CASE e.event_id % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END AS validator,
               CASE WHEN e.event_type = 'error' THEN 'Error' WHEN e.event_type = 'view' THEN 'Warning' WHEN e.event_type = 'click' THEN 'ERROR' ELSE 'Info' END AS severity,
               CASE WHEN e.user_id % 2 = 0 THEN 'left' ELSE 'right' END AS writer,
               CASE e.user_id % 4 WHEN 0 THEN 'SEG' WHEN 1 THEN 'SR' WHEN 2 THEN 'RT' ELSE 'PM' END AS class,
               CASE e.event_id % 5
                 WHEN 0 THEN concat('Missing attribute Element=<', e.event_type, '> in frame ', CAST(e.event_id AS VARCHAR(20)))
                 WHEN 1 THEN concat('Value = <', CAST(e.value AS VARCHAR(30)), '> is not allowed at [', CAST(e.user_id AS VARCHAR(20)), '] Element=<', e.event_type, '>')
                 WHEN 2 THEN concat('Unexpected "', e.event_type, '" under 1.2.840.', CAST(e.event_id AS VARCHAR(20)), '.7')
                 WHEN 3 THEN concat('(0008,', CAST(1000 + e.user_id % 9 AS VARCHAR(9)), ') is of Type ', CAST(e.event_id % 2 + 1 AS VARCHAR(9)), '  and empty')
                 ELSE concat('Retired ', e.event_type, ' at item ', CAST(e.event_id % 40 AS VARCHAR(9))) END AS message
        FROM events e""",
    # attempts of an append-only log
    "attempt": """
        SELECT e.event_id AS ordinal, e.user_id AS uid, CASE WHEN e.event_type = 'error' THEN 'FAILED' ELSE 'OK' END AS status,
               CASE WHEN e.event_type = 'error' THEN NULL ELSE e.event_type END AS outcome
        FROM events e""",
    # claims: one row for each, with sources and references as text
    "claim": """
        SELECT concat('C-', CAST(p.p_partkey AS VARCHAR(20))) AS id, concat('section ', CAST(p.p_size % 9 AS VARCHAR(9))) AS section,
               CASE WHEN p.p_size % 3 = 0 THEN concat(CAST(p.p_size AS VARCHAR(9)), ' percent of ', p.p_name) WHEN p.p_size % 3 = 1 THEN concat(p.p_name, ' is ', p.p_type) ELSE concat(CAST(p.p_size AS VARCHAR(9)), ' of ', CAST(p.p_size * 2 AS VARCHAR(9))) END AS claim,
               CASE p.p_partkey % 6 WHEN 0 THEN 'MEASURED' WHEN 1 THEN 'VERIFIED' WHEN 2 THEN 'DERIVED' WHEN 3 THEN 'PENDING' WHEN 4 THEN 'LITERATURE' ELSE 'RETIRED' END AS status,
               CASE WHEN p.p_size % 5 = 0 THEN '' WHEN p.p_size % 5 = 1 THEN NULL ELSE p.p_brand END AS floor_value,
               CASE WHEN p.p_partkey % 4 = 0 THEN '' WHEN p.p_partkey % 4 = 1 THEN concat('src', CAST(p.p_partkey % 30 AS VARCHAR(9))) ELSE concat('src', CAST(p.p_partkey % 30 AS VARCHAR(9)), ' and src', CAST(p.p_partkey % 17 AS VARCHAR(9))) END AS sources,
               CASE WHEN p.p_partkey % 3 = 0 THEN NULL ELSE concat('C-', CAST(p.p_partkey * 2 AS VARCHAR(20)), ', C-', CAST(p.p_partkey + 1 AS VARCHAR(20))) END AS derived_from,
               CASE WHEN p.p_partkey % 6 = 5 AND p.p_size % 2 = 0 THEN concat('C-', CAST(p.p_partkey + 6 AS VARCHAR(20))) ELSE NULL END AS superseded_by
        FROM part p""",
}


def _names(sql: str) -> set[str]:
    return set(re.findall(r"\b[a-z_]+\b", sql))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    used = {t: read_table(spark, sf_dir, t) for t in TABLES if t in _names(VIEWS[name])}
    sql = VIEWS[name]
    for t in used:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **used)


def with_views(sql: str) -> str:
    """The oracle's SQL, with the views it uses put in front."""
    used = [f"{v} AS ({VIEWS[v]})" for v in VIEWS if v in _names(sql)]
    body = sql.strip()
    if not used:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {', '.join(used)}, {body[14:].strip()}"
    return f"WITH {', '.join(used)}, {body[4:].strip()}" if body.upper().startswith("WITH") else f"WITH {', '.join(used)} {body}"


class Registry:
    """Collects a module's queries: @r.query("name", SQL) on a function of (spark, sf_dir)."""

    def __init__(self):
        self.queries, self.oracles = {}, {}

    def query(self, name: str, sql: str | None = None):
        def put(f):
            self.queries[name] = f
            if sql:
                self.oracles[name] = with_views(sql)
            return f

        return put
