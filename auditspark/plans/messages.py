"""Record logs, validator messages, class sets and adjudication."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditspark.functions import rules as R
from auditspark.functions import text as X
from auditspark.functions.stats import kappa as kappa_of
from auditspark.functions.stats import percent
from auditspark.operators import census as C
from auditspark.operators import findings as M
from auditspark.operators import records as L
from auditspark.operators.quantiles import quantiles
from auditspark.operators.ranges import numbered
from auditspark.plans.vocabulary import BANNER, FAMILY_STEPS, MESSAGE_STEPS, SEVERITY, case_sql
from auditspark.plans.views import Registry, view
from auditspark.session import materialise, read_table

r = Registry()
QUERIES, ORACLES = r.queries, r.oracles

STEPS_SQL = "message"
for _p, _to in MESSAGE_STEPS:
    STEPS_SQL = f"regexp_replace({STEPS_SQL}, '{_p.replace(chr(39), chr(39) * 2)}', '{_to.replace('$1', chr(92) + '1')}', 'g')"
STEPS_SQL = f"trim({STEPS_SQL})"
FAMILY_SQL = "template"
for _p, _to in FAMILY_STEPS:
    FAMILY_SQL = f"regexp_replace({FAMILY_SQL}, '{_p}', '{_to}', 'g')"
FAMILY_SQL = f"lower(trim({FAMILY_SQL}))"
CLASSED = f"""k AS (SELECT *, {STEPS_SQL} AS template FROM msg), m AS (SELECT *, left(sha256(concat(validator, '|', template)), 12) AS cid, {FAMILY_SQL} AS family FROM k)"""

VERDICTS = [("NET", "missing attribute", "^missing attribute"), ("FLOOR", "retired", "^retired"), ("NET", "type 1", "of type 1"), ("UNDECIDABLE", "value", "not allowed"), ("FLOOR", "empty type 2", "of type 2")]
SECOND = [("NET", "missing", "missing"), ("FLOOR", "retired or unexpected", "retired|unexpected"), ("NET", "not allowed", "not allowed")]
VERDICT_SQL = case_sql("family", VERDICTS, 0, "CASE WHEN validator = 'gamma' THEN 'FLOOR' ELSE 'UNDECIDABLE' END")
RULE_SQL = case_sql("family", VERDICTS, 1, "'default'")
SECOND_SQL = case_sql("family", SECOND, 0, "'UNDECIDABLE'")


def msg(spark, sf_dir):
    m = view(spark, sf_dir, "msg").withColumn("template", X.normalise_message(F.col("message"), MESSAGE_STEPS))
    return m.withColumn("cid", X.message_class_id(F.col("validator"), F.col("template"))).withColumn("family", X.message_family(F.col("template"), FAMILY_STEPS))


def verdict():
    default = R.decision(F.when(F.col("validator") == "gamma", "FLOOR").otherwise("UNDECIDABLE"), F.lit("default"))
    return R.first_match(F.col("family"), VERDICTS, default)


def second():
    return R.first_match(F.col("family"), SECOND, R.decision(F.lit("UNDECIDABLE"), F.lit("")))["category"]


@r.query("normalise_message", f"WITH {CLASSED} SELECT line, template FROM m")
def normalise_message(spark, sf_dir):
    """CLS16."""
    return msg(spark, sf_dir).select("line", "template")


@r.query("message_class_id", f"WITH {CLASSED} SELECT validator, template, cid, count(*) AS lines FROM m GROUP BY ALL")
def message_class_id(spark, sf_dir):
    """CLS17."""
    return msg(spark, sf_dir).groupBy("validator", "template", "cid").agg(F.count("*").alias("lines"))


@r.query("message_family", f"WITH {CLASSED} SELECT family, count(DISTINCT template) AS templates, count(*) AS lines FROM m GROUP BY family")
def message_family(spark, sf_dir):
    """CLS18."""
    return msg(spark, sf_dir).groupBy("family").agg(F.count_distinct("template").alias("templates"), F.count("*").alias("lines"))


@r.query("adjudicate", f"WITH {CLASSED} SELECT DISTINCT validator, family, {VERDICT_SQL} AS verdict, {RULE_SQL} AS rule FROM m")
def adjudicate(spark, sf_dir):
    """CLS19: on distinct families, with a default for each validator."""
    v = verdict()
    return msg(spark, sf_dir).select("validator", "family").distinct().select("validator", "family", v["category"].alias("verdict"), v["rule"].alias("rule"))


@r.query(
    "adjudicate_exactly_one",
    f"WITH {CLASSED}, h AS (SELECT DISTINCT family, list_filter([{', '.join(f'CASE WHEN regexp_matches(family, {chr(39)}{p}{chr(39)}) THEN {chr(39)}{n}{chr(39)} END' for _, n, p in VERDICTS)}], lambda x: x IS NOT NULL) AS hits FROM m) SELECT family, len(hits)::INTEGER AS n_rules, array_to_string(hits, ', ') AS rules, len(hits) = 1 AS ok FROM h",
)
def adjudicate_exactly_one(spark, sf_dir):
    """CLS20: the audit of a table that has to be complete and unambiguous."""
    hits = R.matches(F.col("family"), VERDICTS)
    return msg(spark, sf_dir).select("family").distinct().select("family", F.size(hits).alias("n_rules"), F.array_join(hits, ", ").alias("rules"), (F.size(hits) == 1).alias("ok"))


WORDS = {"view": "FLOOR", "error": "NET", "click": "NET", "purchase": "AMBIGUOUS"}
STRICT = {"view": "FLOOR", "error": "NET"}


@r.query(
    "crosswalk",
    f"SELECT event_type, coalesce({' '.join(['CASE event_type', *[f'WHEN {chr(39)}{k}{chr(39)} THEN {chr(39)}{v}{chr(39)}' for k, v in WORDS.items()], 'END'])}, 'UNDECIDABLE') AS lenient, coalesce({' '.join(['CASE event_type', *[f'WHEN {chr(39)}{k}{chr(39)} THEN {chr(39)}{v}{chr(39)}' for k, v in STRICT.items()], 'END'])}, 'UNDECIDABLE') AS strict, count(*) AS n FROM events GROUP BY ALL",
)
def crosswalk(spark, sf_dir):
    """CLS21: one vocabulary in terms of another, lenient and strict."""
    to = lambda d: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in d.items() for x in kv]), F.col("event_type")), F.lit("UNDECIDABLE"))
    return read_table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n")).select("event_type", to(WORDS).alias("lenient"), to(STRICT).alias("strict"), "n")


@r.query("pre_disclosed", f"WITH {CLASSED} SELECT DISTINCT family, contains(family, 'retired') OR contains(family, 'frame') AS disclosed FROM m")
def pre_disclosed(spark, sf_dir):
    """CLS22."""
    return msg(spark, sf_dir).select("family").distinct().withColumn("disclosed", R.contains_any(F.col("family"), ["retired", "frame"]))


KEPT = """a AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY CASE WHEN status = 'OK' THEN 0 ELSE 1 END, ordinal) AS rn FROM attempt),
          b AS (SELECT * FROM a WHERE rn = 1)"""


@r.query(
    "record_merge",
    f"""WITH {KEPT} SELECT b.uid, b.ordinal, b.status = 'OK' AS kept_ok, b.outcome, count(*) AS attempts, count(*) FILTER (WHERE a.status <> 'OK') AS failures, count(*) - 1 AS duplicates,
        count(*) FILTER (WHERE a.status = 'OK' AND b.status = 'OK' AND a.outcome <> b.outcome) AS disagreements FROM b JOIN a USING (uid) GROUP BY ALL""",
)
def record_merge(spark, sf_dir):
    """SRC3."""
    return L.merge_attempts(view(spark, sf_dir, "attempt"), "uid", "ordinal", F.col("status") == "OK", ["outcome"])


@r.query("merge_report", f"WITH {KEPT} SELECT count(DISTINCT uid) AS keys, (SELECT count(*) FROM a) - count(DISTINCT uid) AS duplicate_lines, count(*) FILTER (WHERE status <> 'OK') AS failed_only, (SELECT count(DISTINCT uid) FROM a WHERE status <> 'OK') AS failed_at_least_once FROM b")
def merge_report(spark, sf_dir):
    """SRC3's bookkeeping."""
    m = record_merge(spark, sf_dir)
    return m.agg(F.count("*").alias("keys"), F.sum("duplicates").alias("duplicate_lines"), F.count_if(~F.col("kept_ok")).alias("failed_only"), F.count_if(F.col("failures") > 0).alias("failed_at_least_once"))


@r.query(
    "record_fingerprint",
    """WITH v AS (SELECT l_orderkey AS uid, concat('{"n":', l_linenumber, ',"f":"', l_returnflag, '"}') AS j FROM lineitem)
       SELECT uid, sha256(string_agg(j, chr(10) ORDER BY j)) AS fingerprint FROM v GROUP BY uid""",
)
def record_fingerprint(spark, sf_dir):
    """SRC4."""
    items = F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("f")))  # an object's own items
    return read_table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("uid")).agg(L.fingerprint(items).alias("fingerprint"))


@r.query("union_records", "SELECT source, count(*) AS n, count(size) AS sized FROM (SELECT 'orders' AS source, o_totalprice AS size FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT 'events', NULL FROM events WHERE event_type <> 'error' AND value >= 5) GROUP BY source")
def union_records(spark, sf_dir):
    """SRC5."""
    return _united(spark, sf_dir)[0].groupBy("source").agg(F.count("*").alias("n"), F.count("size").alias("sized"))


def _united(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("uid"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("size"))
    e = read_table(spark, sf_dir, "events").select(F.col("event_id").alias("uid"), F.col("event_type").alias("status"), F.col("value").alias("v"))
    return L.union_with_ledger({"orders": (o, F.when(F.col("status") == "P", "partial")), "events": (e, F.when(F.col("status") == "error", "failed").when(F.col("v") < 5, "too small"))})


@r.query("excluded_ledger", "SELECT 'orders' AS source, 'partial' AS reason, count(*) AS n FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'events', CASE WHEN event_type = 'error' THEN 'failed' ELSE 'too small' END, count(*) FROM events WHERE event_type = 'error' OR value < 5 GROUP BY 2")
def excluded_ledger(spark, sf_dir):
    """SRC5's ledger."""
    return _united(spark, sf_dir)[1]


def objects(spark, sf_dir):
    """Nested records: an order with its lines as an array."""
    lines = view(spark, sf_dir, "seg").groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("number", "part", "kind", "identification", "price"))).alias("objects"))
    o = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("uid"), F.col("o_orderpriority").alias("class"), F.when(F.col("o_orderstatus") == "P", "FETCH_FAILED").otherwise("OK").alias("status"))
    return o.join(lines, "uid", "left")


@r.query("flatten_objects", "SELECT o_orderpriority AS class, count(DISTINCT o_orderkey) AS series, count(l_orderkey) AS objects, count(DISTINCT o_orderkey) FILTER (WHERE l_orderkey IS NULL) AS empty_series FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P' GROUP BY 1")
def flatten_objects(spark, sf_dir):
    """SRC6."""
    flat = objects(spark, sf_dir).filter("status = 'OK'").select("uid", "class", F.explode_outer("objects").alias("o"))
    return flat.groupBy("class").agg(F.count_distinct("uid").alias("series"), F.count("o").alias("objects"), F.count_distinct(F.when(F.col("o").isNull(), F.col("uid"))).alias("empty_series"))


@r.query("flatten_messages", f"WITH {CLASSED} SELECT uid, validator, cid, arg_min(severity, line) AS severity, arg_min(template, line) AS template, count(*) AS lines FROM m GROUP BY uid, validator, cid")
def flatten_messages(spark, sf_dir):
    """SRC7: distinct classes of an object; the first line settles severity and template."""
    return msg(spark, sf_dir).groupBy("uid", "validator", "cid").agg(F.min_by("severity", "line").alias("severity"), F.min_by("template", "line").alias("template"), F.count("*").alias("lines"))


RANKS = {"1-URGENT": 1, "2-HIGH": 2}


@r.query("manifest", "SELECT o_orderkey AS uid, o_orderpriority AS class, row_number() OVER (ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 1 ELSE 2 END, o_totalprice, o_orderkey) AS place FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def manifest(spark, sf_dir):
    """SRC8: the whole plan, cheapest first within a class. Each range of the order is numbered by itself, from the
    number of rows in the ranges before it."""
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in RANKS.items() for x in kv]), F.col("o_orderpriority"))
    order = [rank, F.col("o_totalprice"), F.col("o_orderkey")]
    plan = read_table(spark, sf_dir, "orders").filter(F.col("o_orderpriority").isin(*RANKS)).select("o_orderkey", "o_orderpriority", "o_totalprice")
    return numbered(plan, order).select(F.col("o_orderkey").alias("uid"), F.col("o_orderpriority").alias("class"), "place")


@r.query("resume_pending", "SELECT o_orderkey AS uid FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def resume_pending(spark, sf_dir):
    """SRC9."""
    return L.pending(read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("uid")), read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("uid")), "uid")


@r.query(
    "byte_batches",
    """WITH RECURSIVE o AS (SELECT o_orderkey AS key, CAST(round(o_totalprice * 100) AS BIGINT) AS size, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS n FROM orders),
       p AS (SELECT *, (sum(size) OVER (ORDER BY n) - size)::BIGINT AS before FROM o), ends AS (SELECT n, before FROM p UNION ALL SELECT count(*), sum(size)::BIGINT FROM p),
       nx AS MATERIALIZED (SELECT p.n, least(greatest(e.n, p.n + 1), p.n + 12) AS too FROM p ASOF JOIN (SELECT before, max(n) AS n FROM ends GROUP BY before) e ON p.before + 200000000 >= e.before),
       w AS (SELECT 0::BIGINT AS n, 0::BIGINT AS batch UNION ALL SELECT nx.too, w.batch + 1 FROM w JOIN nx ON nx.n = w.n)
       SELECT key, size, w.batch FROM o ASOF JOIN w ON o.n >= w.n""",
)
def byte_batches(spark, sf_dir):
    """SRC10: sizes in cents."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.round(F.col("o_totalprice") * 100).cast("long").alias("size"))
    return L.byte_batches(o, [F.col("o_orderdate"), F.col("o_orderkey")], "size", "o_orderkey", 200_000_000, 12)


@r.query(
    "completeness",
    """WITH p AS (SELECT o_orderpriority AS class, count(DISTINCT o_orderkey) AS planned FROM orders GROUP BY 1), q AS (SELECT o_orderpriority AS class, count(DISTINCT o_orderkey) AS recorded FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority <> '5-LOW' GROUP BY 1)
       SELECT class, coalesce(planned, 0) AS planned, coalesce(recorded, 0) AS recorded, CASE WHEN coalesce(recorded, 0) = 0 THEN 'not started' WHEN recorded < planned THEN 'in flight' ELSE 'complete' END AS state FROM p FULL JOIN q USING (class)""",
)
def completeness(spark, sf_dir):
    """SRC11, FIL5."""
    o = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("uid"), F.col("o_orderpriority").alias("class"))
    done = o.filter("class <> '5-LOW'").join(read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("uid")), "uid", "left_semi")
    return L.completeness(done, o, "class", "uid")


@r.query(
    "reportable_only",
    """WITH q AS (SELECT o_orderpriority AS class, count(DISTINCT o_orderkey) AS p, count(DISTINCT l_orderkey) AS s FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
       SELECT o_orderpriority AS class, count(*) AS series, CASE WHEN any_value(s) > 0.98 * any_value(p) THEN round(100.0 * count(*) FILTER (WHERE o_orderstatus = 'F') / count(*), 2) END AS pct FROM orders JOIN q ON class = o_orderpriority GROUP BY 1""",
)
def reportable_only(spark, sf_dir):
    """FIL5: rates of the classes that are near enough to complete, counts of all."""
    o = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("uid"), F.col("o_orderpriority").alias("class"), F.col("o_orderstatus").alias("status"))
    done = L.completeness(o.join(read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("uid")), "uid", "left_semi"), o, "class", "uid")
    good = done.filter(F.col("recorded") > 0.98 * F.col("planned")).select("class", F.lit(True).alias("good"))
    n = o.groupBy("class").agg(F.count("*").alias("series"), F.count_if(F.col("status") == "F").alias("k")).join(good, "class", "left")
    return n.select("class", "series", F.when(F.col("good"), percent(F.col("k"), F.col("series"))).alias("pct"))


LOGS = "SELECT uid, validator, concat(CASE WHEN uid % 3 = 0 THEN concat('Segmentation', chr(10)) WHEN uid % 3 = 1 THEN concat('no type found', chr(10)) ELSE '' END, string_agg(CASE WHEN line % 4 = 0 THEN message ELSE concat(severity, ' - ', message) END, chr(10) ORDER BY line)) AS log FROM msg GROUP BY uid, validator"


def logs(spark, sf_dir):
    m = view(spark, sf_dir, "msg")
    shown = F.when(F.col("line") % 4 == 0, F.col("message")).otherwise(F.concat_ws(" - ", "severity", "message"))
    head = F.when(F.col("uid") % 3 == 0, "Segmentation\n").when(F.col("uid") % 3 == 1, "no type found\n").otherwise("")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", shown.alias("t")))), lambda x: x.t), "\n")
    return m.groupBy("uid", "validator").agg(text.alias("log")).withColumn("log", F.concat(head, "log"))


@r.query(
    "split_findings",
    f"""WITH g AS ({LOGS}), l AS (SELECT uid, validator, (generate_subscripts(string_split(log, chr(10)), 1) - 1)::INTEGER AS pos, unnest(string_split(log, chr(10))) AS line FROM g),
        t AS (SELECT *, regexp_extract(line, '(?:^|\\s-\\s)(Error|Warning)\\s-\\s', 1) AS s FROM l WHERE trim(line) <> ''),
        f AS (SELECT *, min(CASE WHEN s = '' AND regexp_matches(trim(line), '^[A-Z][A-Za-z0-9]{{3,}}$') THEN pos END) OVER (PARTITION BY uid, validator) AS b FROM t)
        SELECT uid, validator, pos, line, CASE WHEN s <> '' THEN s WHEN pos = b THEN 'BANNER' ELSE 'UNCLASSIFIED' END AS severity FROM f""",
)
def split_findings(spark, sf_dir):
    """LOG1."""
    return M.split_findings(logs(spark, sf_dir), ["uid", "validator"], "log", SEVERITY, BANNER)


#: A log of each object with all kinds of lines: (banner, section, module, context) patterns and the start of a flush finding.
SECTION_KINDS = (r'^SOP class is "[^"]+" \((.+)\)$', "^(Errors|Warnings)$", '^Module "([^"]+)":', r"^(\([0-9A-Fa-f]{4},[0-9A-Fa-f]{4}\).*):$", "Tag ")
SECTIONED = """SELECT uid, concat('SOP class is "1.2" (', class, ')', chr(10), '=====', chr(10), 'Tag before any section', chr(10), '  indented before any section', chr(10), 'Errors', chr(10), string_agg(
    CASE WHEN line % 13 = 0 THEN CASE WHEN line % 2 = 0 THEN 'Warnings' ELSE 'Errors  ' END WHEN line % 5 = 0 THEN concat('Module "', validator, '": ', severity) WHEN line % 4 = 0 THEN concat('  (0040,', lpad(CAST(line % 977 AS VARCHAR(9)), 4, '0'), ') sequence:')
         WHEN line % 17 = 0 THEN '  ' WHEN line % 3 = 0 THEN concat('Tag ', message) WHEN line % 7 = 0 THEN message WHEN line % 11 = 0 THEN concat(chr(9), message) ELSE concat('  ', message, ' ') END, chr(10) ORDER BY line)) AS log FROM msg GROUP BY uid, class"""


@r.query(
    "split_sectioned",
    f"""WITH g AS ({SECTIONED}), l AS (SELECT uid, (generate_subscripts(string_split(log, chr(10)), 1) - 1)::INTEGER AS pos, unnest(string_split(log, chr(10))) AS line FROM g),
        c AS (SELECT uid, pos, regexp_replace(line, '\\s+$', '') AS raw, regexp_replace(regexp_replace(line, '\\s+$', ''), '^\\s+', '') AS t FROM l),
        k AS (SELECT *, regexp_matches(raw, '^(  |\\t)') AS indented, CASE WHEN starts_with(t, 'SOP class is "') AND t LIKE '%)' THEN 'banner' WHEN t IN ('Errors', 'Warnings') THEN 'section' WHEN starts_with(t, 'Module "') THEN 'module' WHEN regexp_matches(t, '^\\([0-9A-Fa-f]{{4}},[0-9A-Fa-f]{{4}}\\).*:$') THEN 'context' ELSE 'line' END AS kind FROM c WHERE t <> '' AND replace(t, '=', '') <> ''),
        s AS (SELECT uid, pos AS spot, upper(rtrim(t, 's')) AS severity FROM k WHERE kind = 'section'), m AS (SELECT uid, pos AS spot, split_part(t, '"', 2) AS module FROM k WHERE kind = 'module'), x AS (SELECT uid, pos AS spot, rtrim(t, ':') AS context FROM k WHERE kind = 'context'),
        b AS (SELECT uid, arg_max(regexp_extract(t, '\\((.+)\\)$', 1), pos) AS banner FROM k WHERE kind = 'banner' GROUP BY uid),
        f AS (SELECT k.*, s.severity FROM k ASOF JOIN s ON k.uid = s.uid AND k.pos >= s.spot WHERE kind = 'line' AND (indented OR starts_with(t, 'Tag '))),
        e AS (SELECT uid, spot FROM m UNION ALL SELECT uid, pos FROM f WHERE NOT indented),
        j AS (SELECT f.*, b.banner, m.module, x.context, x.spot AS x_at, e.spot AS e_at FROM f LEFT JOIN b USING (uid) ASOF LEFT JOIN m ON f.uid = m.uid AND f.pos >= m.spot ASOF LEFT JOIN x ON f.uid = x.uid AND f.pos >= x.spot ASOF LEFT JOIN e ON f.uid = e.uid AND f.pos >= e.spot),
        r AS (SELECT uid, pos, banner, severity, module, CASE WHEN x_at > coalesce(e_at, -1) THEN context END AS context, indented, t AS finding FROM j)
        SELECT *, concat('Module <', coalesce(module, '?'), '> ', coalesce(context, ''), ' ', finding) AS message FROM r""",
)
def split_sectioned(spark, sf_dir):
    """LOG2."""
    m = view(spark, sf_dir, "msg")
    line = F.col("line")
    shown = (
        F.when(line % 13 == 0, F.when(line % 2 == 0, "Warnings").otherwise("Errors  "))
        .when(line % 5 == 0, F.concat(F.lit('Module "'), "validator", F.lit('": '), "severity"))
        .when(line % 4 == 0, F.concat(F.lit("  (0040,"), F.lpad((line % 977).cast("string"), 4, "0"), F.lit(") sequence:")))
        .when(line % 17 == 0, "  ")
        .when(line % 3 == 0, F.concat(F.lit("Tag "), "message"))
        .when(line % 7 == 0, F.col("message"))
        .when(line % 11 == 0, F.concat(F.lit("\t"), "message"))
        .otherwise(F.concat(F.lit("  "), "message", F.lit(" ")))
    )
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", shown.alias("t")))), lambda x: x.t), "\n")
    head = F.concat(F.lit('SOP class is "1.2" ('), "class", F.lit(")\n=====\nTag before any section\n  indented before any section\nErrors\n"))
    banner, section, module, context, flush = SECTION_KINDS
    return M.split_sectioned(m.groupBy("uid", "class").agg(text.alias("log")).select("uid", F.concat(head, "log").alias("log")), ["uid"], "log", section, module, context, banner, flush)


PREFIXED = """pf AS (SELECT uid, concat('I: Testing: /tmp/', uid, chr(10), string_agg(CASE WHEN line % 6 = 0 THEN message WHEN severity = 'Error' THEN concat('E: ', message) WHEN severity = 'Warning' THEN concat('W: Error - ', message) WHEN severity = 'ERROR' THEN concat('W: ', message) ELSE concat('I: ', message) END, chr(10) ORDER BY line), CASE WHEN bool_or(severity = 'Error') THEN '' ELSE concat(chr(10), 'W: Test passed.') END) AS log FROM msg GROUP BY uid),
  pl AS (SELECT uid, (generate_subscripts(string_split(log, chr(10)), 1) - 1)::INTEGER AS pos, trim(unnest(string_split(log, chr(10)))) AS message FROM pf),
  pk AS (SELECT uid, pos, message, regexp_extract(message, '^([WEI]): ', 1) AS letter, trim(regexp_replace(message, '^[WEI]: ', '')) AS body, regexp_extract(message, '(?:^|\\s-\\s)(Error|Warning)\\s-\\s', 1) AS said FROM pl WHERE message <> ''),
  pp AS (SELECT uid, pos, message, CASE WHEN regexp_matches(body, '^Testing:[ \\t]') THEN 'banner' WHEN starts_with(body, 'Test passed') THEN 'passed' ELSE 'finding' END AS kind, CASE WHEN said <> '' THEN said WHEN letter = 'W' THEN 'Warning' WHEN letter = 'E' THEN 'Error' ELSE 'UNCLASSIFIED' END AS s FROM pk)"""


def prefixed(spark, sf_dir):
    """Logs with a banner, lettered findings and, where nothing failed, a verdict, parsed."""
    m = view(spark, sf_dir, "msg")
    shown = F.when(F.col("line") % 6 == 0, F.col("message")).when(F.col("severity") == "Error", F.concat(F.lit("E: "), "message")).when(F.col("severity") == "Warning", F.concat(F.lit("W: Error - "), "message")).when(F.col("severity") == "ERROR", F.concat(F.lit("W: "), "message")).otherwise(F.concat(F.lit("I: "), "message"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", shown.alias("t")))), lambda x: x.t), "\n")
    g = m.groupBy("uid").agg(text.alias("t"), F.bool_or(F.col("severity") == "Error").alias("bad"))
    log = F.concat(F.lit("I: Testing: /tmp/"), F.col("uid").cast("string"), F.lit("\n"), "t", F.when(F.col("bad"), "").otherwise("\nW: Test passed."))
    return M.split_prefixed(g.select("uid", log.alias("log")), ["uid"], "log", SEVERITY)


@r.query("split_prefixed", f"WITH {PREFIXED} SELECT uid, pos, kind, CASE WHEN kind = 'finding' THEN s END AS severity, message FROM pp")
def split_prefixed(spark, sf_dir):
    """LOG3: banner, verdict and findings apart."""
    return prefixed(spark, sf_dir)


@r.query(
    "rates_by_cell",
    f"""WITH {CLASSED} SELECT class, writer, count(DISTINCT uid) AS objects, count(DISTINCT uid) FILTER (WHERE upper(severity) LIKE 'ERR%') AS error_objects, count(DISTINCT uid) FILTER (WHERE upper(severity) LIKE 'WARN%') AS warning_objects,
        count(DISTINCT uid) FILTER (WHERE contains(family, 'retired')) AS retired_objects, round(100.0 * count(DISTINCT uid) FILTER (WHERE upper(severity) LIKE 'ERR%') / count(DISTINCT uid), 2) AS pct_error FROM m GROUP BY class, writer""",
)
def rates_by_cell(spark, sf_dir):
    """AGG19: severities by their upper-case prefix. One row per object first, so no distinct set is built."""
    s = F.upper("severity")
    per = msg(spark, sf_dir).groupBy("class", "writer", "uid").agg(F.bool_or(F.startswith(s, F.lit("ERR"))).alias("e"), F.bool_or(F.startswith(s, F.lit("WARN"))).alias("w"), F.bool_or(F.contains("family", F.lit("retired"))).alias("r"))
    return per.groupBy("class", "writer").agg(F.count("*").alias("objects"), F.count_if("e").alias("error_objects"), F.count_if("w").alias("warning_objects"), F.count_if("r").alias("retired_objects"), percent(F.count_if("e"), F.count("*")).alias("pct_error"))


@r.query("message_distribution", f"WITH {CLASSED} SELECT validator, cid, min(template) AS template, count(DISTINCT uid) AS objects FROM m GROUP BY validator, cid")
def message_distribution(spark, sf_dir):
    """AGG21."""
    return msg(spark, sf_dir).groupBy("validator", "cid").agg(F.min("template").alias("template"), F.count_distinct("uid").alias("objects"))


@r.query("top_classes", f"WITH {CLASSED}, n AS (SELECT class, cid, min(template) AS template, count(DISTINCT uid) AS objects FROM m GROUP BY class, cid) SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY class ORDER BY objects DESC, cid) <= 6")
def top_classes(spark, sf_dir):
    """AGG22."""
    n = msg(spark, sf_dir).groupBy("class", "cid").agg(F.min("template").alias("template"), F.count_distinct("uid").alias("objects"))
    return C.top(n, ["class"], [F.desc("objects"), F.asc("cid")], 6)


@r.query("target_hit", f"WITH {CLASSED} SELECT class, count(DISTINCT uid) FILTER (WHERE contains(template, 'Retired view')) AS hits, count(DISTINCT uid) AS objects FROM m GROUP BY class")
def target_hit(spark, sf_dir):
    """AGG44."""
    return msg(spark, sf_dir).groupBy("class").agg(F.count_distinct(F.when(F.contains("template", F.lit("Retired view")), F.col("uid"))).alias("hits"), F.count_distinct("uid").alias("objects"))


@r.query(
    "exposure_residue",
    f"WITH {CLASSED}, x AS (SELECT uid FROM msg WHERE severity = 'Error' GROUP BY uid HAVING count(*) >= 12) SELECT cid, min(template) AS template, count(DISTINCT uid) AS objects FROM m WHERE uid IN (SELECT uid FROM x) AND (contains(template, 'Missing') OR contains(template, 'Retired')) GROUP BY cid",
)
def exposure_residue(spark, sf_dir):
    """FIL8."""
    m = msg(spark, sf_dir)
    exposed = m.filter("severity = 'Error'").groupBy("uid").agg(F.count("*").alias("n")).filter("n >= 12")
    return m.join(exposed, "uid", "left_semi").filter(R.contains_any(F.col("template"), ["Missing", "Retired"])).groupBy("cid").agg(F.min("template").alias("template"), F.count_distinct("uid").alias("objects"))


@r.query(
    "pass_summary",
    f"""WITH {PREFIXED}, o AS (SELECT uid, bool_or(kind = 'passed') AS passed, count(*) FILTER (WHERE kind = 'banner') AS banners, count(*) FILTER (WHERE kind = 'finding') AS findings, count(DISTINCT CASE WHEN kind = 'finding' THEN sha256(message) END) AS classes, CASE WHEN bool_or(kind = 'finding' AND s = 'Error') THEN 1 ELSE 0 END AS returncode FROM pp GROUP BY uid
          UNION ALL SELECT 100000 + n_nationkey, true, 1, 0, 0, 0 FROM nation)
        SELECT CASE WHEN passed THEN 'passed' ELSE 'failed' END AS verdict, returncode, count(*) AS objects, sum(banners)::BIGINT AS banners, count(*) FILTER (WHERE findings > 0) AS with_finding, sum(classes)::BIGINT AS classes FROM o GROUP BY ALL""",
)
def pass_summary(spark, sf_dir):
    """AGG41: verdicts, return codes, banners and classes; objects without a finding are kept."""
    finding = F.col("kind") == "finding"
    o = prefixed(spark, sf_dir).groupBy("uid").agg(
        F.bool_or(F.col("kind") == "passed").alias("passed"),
        F.count_if(F.col("kind") == "banner").alias("banners"),
        F.count_if(finding).alias("findings"),
        F.count_distinct(F.when(finding, F.sha2("message", 256))).alias("classes"),
        F.when(F.bool_or(finding & (F.col("severity") == "Error")), 1).otherwise(0).alias("returncode"),
    )
    silent = read_table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100000).cast("long").alias("uid"), F.lit(True).alias("passed"), F.lit(1).cast("long").alias("banners"), F.lit(0).cast("long").alias("findings"), F.lit(0).cast("long").alias("classes"), F.lit(0).alias("returncode"))
    return o.unionByName(silent).groupBy(F.when(F.col("passed"), "passed").otherwise("failed").alias("verdict"), "returncode").agg(F.count("*").alias("objects"), F.sum("banners").alias("banners"), F.count_if(F.col("findings") > 0).alias("with_finding"), F.sum("classes").alias("classes"))


FLAGS = f"""{CLASSED}, c AS (SELECT class, validator, cid, bool_or(writer = 'left') AS a, bool_or(writer = 'right') AS b, min(template) AS template FROM m GROUP BY class, validator, cid),
  n AS (SELECT class, validator, count(*) FILTER (WHERE a) AS n_a, count(*) FILTER (WHERE b) AS n_b, count(*) FILTER (WHERE a AND b) AS shared, count(*) AS n_union FROM c GROUP BY class, validator),
  g AS (SELECT * FROM (SELECT DISTINCT class FROM msg UNION SELECT 'KOS'), (SELECT DISTINCT validator FROM msg)),
  d AS (SELECT g.class, g.validator, coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b, coalesce(shared, 0) AS shared, coalesce(n_union, 0) AS n_union FROM g LEFT JOIN n USING (class, validator))"""
DIRECTION_SQL = "CASE WHEN n_a = n_b AND shared = n_a THEN 'equal' WHEN shared = n_a THEN 'subset' WHEN shared = n_b THEN 'superset' WHEN shared = 0 THEN 'disjoint' ELSE 'overlapping' END"


def grid(spark, m):
    classes = m.select("class").union(spark.range(1).select(F.lit("KOS").alias("class"))).distinct()
    return classes.join(m.select("validator").distinct())  # a few classes times a few validators


@r.query("jaccard", f"WITH {FLAGS} SELECT class, validator, n_a, n_b, shared, n_union, CASE WHEN n_union = 0 THEN 1.0 ELSE round(shared / n_union, 4) END::DOUBLE AS jaccard, n_union = 0 AS vacuous, {DIRECTION_SQL} AS direction FROM d")
def jaccard(spark, sf_dir):
    """SET1, SET3: every cell of the grid, the empty ones too."""
    m = msg(spark, sf_dir)
    return M.overlap(m, ["class", "validator"], "writer", "left", "right", "cid", grid(spark, m))


@r.query("residue", f"WITH {FLAGS} SELECT class, validator, cid, CASE WHEN a THEN 'left' ELSE 'right' END AS only_in, template FROM c WHERE a <> b")
def residue(spark, sf_dir):
    """SET2."""
    return M.residue(msg(spark, sf_dir), ["class", "validator"], "writer", "left", "right", "cid", "template")


@r.query("direction", f"WITH {FLAGS} SELECT {DIRECTION_SQL} AS direction, count(*) AS cells, count(*) FILTER (WHERE n_union > 0) AS testable FROM d GROUP BY 1")
def direction(spark, sf_dir):
    """SET3."""
    m = msg(spark, sf_dir)
    return M.overlap(m, ["class", "validator"], "writer", "left", "right", "cid", grid(spark, m)).groupBy("direction").agg(F.count("*").alias("cells"), F.count_if(F.col("n_union") > 0).alias("testable"))


LADDER = f"""{CLASSED}, q AS (SELECT *, line % 3 AS rung FROM m), c AS (SELECT rung, class, validator, cid, bool_or(writer = 'left') AS a, bool_or(writer = 'right') AS b FROM q GROUP BY ALL),
  n AS (SELECT rung, class, validator, count(*) FILTER (WHERE a) AS n_a, count(*) FILTER (WHERE b) AS n_b, count(*) FILTER (WHERE a AND b) AS shared FROM c GROUP BY ALL), z AS (SELECT *, {DIRECTION_SQL} AS dir FROM n),
  p AS (SELECT class, validator, max(dir) FILTER (WHERE rung = 0) AS rung0, max(dir) FILTER (WHERE rung = 1) AS rung1, max(dir) FILTER (WHERE rung = 2) AS rung2 FROM z GROUP BY ALL)"""


def _ladder(spark, sf_dir):
    m = msg(spark, sf_dir).withColumn("rung", (F.col("line") % 3).cast("int"))
    o = M.overlap(m, ["rung", "class", "validator"], "writer", "left", "right", "cid")
    p = o.groupBy("class", "validator").pivot("rung", [0, 1, 2]).agg(F.max("direction"))
    return p.select("class", "validator", *[F.col(str(k)).alias(f"rung{k}") for k in range(3)])


@r.query("ladder", f"WITH {LADDER} SELECT class, validator, coalesce(rung0, 'not applicable') AS rung0, coalesce(rung1, 'not applicable') AS rung1, coalesce(rung2, 'not applicable') AS rung2 FROM p")
def ladder(spark, sf_dir):
    """SET4: the comparison over ordered rungs."""
    return _ladder(spark, sf_dir).fillna("not applicable", ["rung0", "rung1", "rung2"])


@r.query("flips", f"WITH {LADDER} SELECT class, validator, rung0 = 'equal' AS degenerate, rung0 <> 'equal' AND rung1 = 'equal' AS flips1, rung0 <> 'equal' AND rung2 = 'equal' AS flips2 FROM p")
def flips(spark, sf_dir):
    """SET20: rungs that make a testable cell equal, and cells that are so from the start."""
    d = F.col("rung0") == "equal"
    return _ladder(spark, sf_dir).select("class", "validator", d.alias("degenerate"), (~d & (F.col("rung1") == "equal")).alias("flips1"), (~d & (F.col("rung2") == "equal")).alias("flips2"))


@r.query(
    "round_trip_control",
    f"WITH {CLASSED}, a AS (SELECT DISTINCT class, validator, cid FROM m WHERE line % 2 = 0), b AS (SELECT DISTINCT class, validator, cid FROM m WHERE line % 2 = 1), x AS ((SELECT 'gone' AS side, * FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) UNION ALL (SELECT 'new', * FROM (SELECT * FROM b EXCEPT SELECT * FROM a))) SELECT class, validator, count(*) FILTER (WHERE side = 'gone') AS gone, count(*) FILTER (WHERE side = 'new') AS new FROM x GROUP BY ALL",
)
def round_trip_control(spark, sf_dir):
    """SET5: cells whose set moved between two runs."""
    m = msg(spark, sf_dir)
    a, b = (m.filter(F.col("line") % 2 == k).select("class", "validator", "cid").distinct() for k in (0, 1))
    moved = a.exceptAll(b).withColumn("side", F.lit("gone")).unionByName(b.exceptAll(a).withColumn("side", F.lit("new")))
    return moved.groupBy("class", "validator").agg(F.count_if(F.col("side") == "gone").alias("gone"), F.count_if(F.col("side") == "new").alias("new"))


@r.query(
    "floor_table",
    f"""WITH {CLASSED}, g AS (SELECT * FROM (SELECT DISTINCT writer FROM msg), (SELECT DISTINCT class FROM msg UNION SELECT 'KOS'), (SELECT DISTINCT validator FROM msg)), c AS (SELECT writer, class, validator, cid, min(template) AS template, count(DISTINCT uid) AS objects FROM m GROUP BY ALL)
        SELECT g.writer, g.class, g.validator, coalesce(c.cid, '') AS cid, coalesce(c.template, 'no message class') AS template, coalesce(c.objects, 0) AS objects,
               CASE WHEN c.cid IS NULL THEN '' ELSE coalesce((SELECT string_agg(o.writer, ', ' ORDER BY o.writer) FROM c o WHERE o.class = g.class AND o.validator = g.validator AND o.cid = c.cid AND o.writer <> g.writer), 'this writer only') END AS shared_with
        FROM g LEFT JOIN c ON c.writer = g.writer AND c.class = g.class AND c.validator = g.validator""",
)
def floor_table(spark, sf_dir):
    """SET6: every cell's classes and which other writers share them; an empty cell has a row."""
    m = msg(spark, sf_dir)
    c = m.groupBy("writer", "class", "validator", "cid").agg(F.min("template").alias("template"), F.count_distinct("uid").alias("objects"))
    # a handful of writers
    c = c.groupBy("class", "validator", "cid").agg(F.array_sort(F.collect_set("writer")).alias("all"), F.collect_list(F.struct("writer", "template", "objects")).alias("w")).select("class", "validator", "cid", "all", F.explode("w").alias("w")).select("w.*", "class", "validator", "cid", "all")
    others = F.array_join(F.array_except("all", F.array("writer")), ", ")
    c = c.withColumn("shared_with", F.when(F.size("all") > 1, others).otherwise("this writer only")).drop("all")
    cells = m.select("writer").distinct().join(grid(spark, m))
    return cells.join(c, ["writer", "class", "validator"], "left").fillna({"cid": "", "template": "no message class", "objects": 0, "shared_with": ""})


@r.query(
    "floor_rows",
    f"WITH {CLASSED}, g AS (SELECT * FROM (SELECT DISTINCT writer FROM msg), (SELECT DISTINCT class FROM msg UNION SELECT 'KOS'), (SELECT DISTINCT validator FROM msg)), s AS (SELECT DISTINCT writer, class, validator, cid FROM m) SELECT writer, class, validator, coalesce(cid, '(empty set)') AS cid FROM g LEFT JOIN s USING (writer, class, validator)",
)
def floor_rows(spark, sf_dir):
    """SET19: distinct rows, and an explicit one for an empty set."""
    m = msg(spark, sf_dir)
    s = m.select("writer", "class", "validator", "cid").distinct()
    return m.select("writer").distinct().join(grid(spark, m)).join(s, ["writer", "class", "validator"], "left").fillna("(empty set)", ["cid"])


PER = f"v AS (SELECT *, {VERDICT_SQL} AS verdict FROM m)"


COUNTS = "count(*) AS gross, count(*) FILTER (WHERE floor) AS floor, count(*) FILTER (WHERE net) AS net, count(*) FILTER (WHERE NOT net AND NOT floor) AS other, count(*) FILTER (WHERE open) AS undecidable"


@r.query(
    "triple",
    f"""WITH {CLASSED}, {PER}, o AS (SELECT class, validator, upper(severity) AS severity, uid, bool_or(verdict = 'NET') AS net, bool_and(verdict = 'FLOOR') AS floor, bool_or(verdict = 'UNDECIDABLE') AS open FROM v GROUP BY ALL),
        t AS (SELECT CASE WHEN grouping(class) = 1 THEN '(all)' ELSE class END AS class, validator, severity, {COUNTS} FROM o GROUP BY GROUPING SETS ((class, validator, severity), (validator, severity))),
        n AS (SELECT CASE WHEN grouping(class) = 1 THEN '(all)' ELSE class END AS class, count(DISTINCT uid) AS objects FROM msg GROUP BY GROUPING SETS ((class), ()))
        SELECT t.*, objects, round(100.0 * gross / objects, 2) AS pct_gross, round(100.0 * floor / objects, 2) AS pct_floor, round(100.0 * net / objects, 2) AS pct_net FROM t JOIN n USING (class)""",
)
def triple(spark, sf_dir):
    """SET7: overall and by class; severities in upper case, so that no tool's spelling is missed."""
    m = msg(spark, sf_dir).withColumn("severity", F.upper("severity"))
    return M.triple(m, m.select("class", "uid"), "class", ["validator", "severity"], "uid", verdict()["category"])


@r.query(
    "net_union",
    f"""WITH {CLASSED}, {PER}, o AS (SELECT class, n_name AS collection, uid, bool_or(verdict = 'NET') AS net FROM v JOIN nation ON n_nationkey = uid % 25 GROUP BY ALL),
        p AS (SELECT CASE WHEN grouping(class) = 1 THEN '(all)' ELSE class END AS class, collection, count(*) AS n, count(*) FILTER (WHERE net) AS k FROM o GROUP BY GROUPING SETS ((class, collection), (collection)))
        SELECT class, sum(n)::BIGINT AS objects, sum(k)::BIGINT AS net_objects, round(100.0 * sum(k) / sum(n), 2) AS pct_net, count(*) AS collections, round(median(100.0 * k / n), 4) AS median_collection_pct FROM p GROUP BY class""",
)
def net_union(spark, sf_dir):
    """SET8: net from any tool or severity, overall and per class, and the median over collections."""
    o = msg(spark, sf_dir).withColumn("v", verdict()["category"]).groupBy("class", "uid").agg(F.bool_or(F.col("v") == "NET").alias("net"))
    n = read_table(spark, sf_dir, "nation").select((F.col("n_nationkey").cast("long")).alias("k"), F.col("n_name").alias("collection"))
    return M.net_union(o.withColumn("k", F.col("uid") % 25).join(n, "k"), "class", "collection", "uid")


@r.query(
    "sensitivity",
    f"""WITH {CLASSED}, {PER}, s(scenario, demoted) AS (VALUES ('as ruled', '-'), ('type 1 demoted', 'type 1'), ('missing demoted', 'missing attribute')),
        o AS (SELECT scenario, class, uid, bool_or(verdict = 'NET' AND {RULE_SQL} <> demoted) AS net FROM v, s GROUP BY ALL) SELECT scenario, class, count(*) AS objects, count(*) FILTER (WHERE net) AS net_objects FROM o GROUP BY ALL""",
)
def sensitivity(spark, sf_dir):
    """SET9: the net count under demotion scenarios, in one pass (a flag for each scenario, no copies of the rows)."""
    v = verdict()
    m = msg(spark, sf_dir).withColumn("v", v["category"]).withColumn("rule", v["rule"])
    scenarios = {"as ruled": "-", "type 1 demoted": "type 1", "missing demoted": "missing attribute"}
    per = m.groupBy("class", "uid").agg(*[F.bool_or((F.col("v") == "NET") & (F.col("rule") != d)).alias(f"s{k}") for k, d in enumerate(scenarios.values())])
    n = per.groupBy("class").agg(F.count("*").alias("objects"), *[F.count_if(f"s{k}").alias(f"n{k}") for k in range(3)])
    return n.select("class", "objects", F.explode(F.array(*[F.struct(F.lit(s).alias("scenario"), F.col(f"n{k}").alias("net_objects")) for k, s in enumerate(scenarios)])).alias("x")).select("x.scenario", "class", "objects", "x.net_objects")


@r.query("per_rule_objects", f"WITH {CLASSED} SELECT {RULE_SQL} AS rule, count(DISTINCT uid) AS objects, count(DISTINCT cid) AS classes FROM m GROUP BY 1")
def per_rule_objects(spark, sf_dir):
    """SET10: distinct objects of a rule, not the sum over its classes."""
    return msg(spark, sf_dir).groupBy(verdict()["rule"].alias("rule")).agg(F.count_distinct("uid").alias("objects"), F.count_distinct("cid").alias("classes"))


@r.query(
    "set_relations",
    f"""WITH {CLASSED}, o AS (SELECT class, uid, bool_or(contains(family, 'missing')) AS a, bool_or(contains(family, 'retired')) AS b FROM m GROUP BY ALL)
        SELECT class, count(*) FILTER (WHERE a AND b) AS both, count(*) FILTER (WHERE a AND NOT b) AS only_a, count(*) FILTER (WHERE b AND NOT a) AS only_b,
          count(*) FILTER (WHERE a AND NOT b) = 0 AS a_in_b, count(*) FILTER (WHERE a AND b) = 0 AS disjoint, count(*) FILTER (WHERE a <> b) = 0 AS identical FROM o GROUP BY class""",
)
def set_relations(spark, sf_dir):
    """SET11."""
    has = lambda n: F.bool_or(F.contains("family", F.lit(n)))
    o = msg(spark, sf_dir).groupBy("class", "uid").agg(has("missing").alias("a"), has("retired").alias("b"))
    n = o.groupBy("class").agg(F.count_if(F.expr("a AND b")).alias("both"), F.count_if(F.expr("a AND NOT b")).alias("only_a"), F.count_if(F.expr("b AND NOT a")).alias("only_b"))
    return n.select("*", (F.col("only_a") == 0).alias("a_in_b"), (F.col("both") == 0).alias("disjoint"), ((F.col("only_a") == 0) & (F.col("only_b") == 0)).alias("identical"))


@r.query(
    "substantial",
    f"""WITH {CLASSED}, {PER}, o AS (SELECT validator, uid, bool_or(verdict = 'NET') AS net FROM v GROUP BY ALL), p AS (SELECT validator, uid % 10 AS unit, avg(CASE WHEN net THEN 100.0 ELSE 0.0 END) AS pct FROM o GROUP BY ALL), q AS (SELECT validator, median(pct) AS med FROM p GROUP BY validator)
        SELECT validator, round(avg(CASE WHEN net THEN 100.0 ELSE 0.0 END), 4) AS overall, round(any_value(med), 4) AS median_unit, avg(CASE WHEN net THEN 100.0 ELSE 0.0 END) > 5 AND any_value(med) > 5 AS substantial FROM o JOIN q USING (validator) GROUP BY validator""",
)
def substantial(spark, sf_dir):
    """SET12."""
    o = msg(spark, sf_dir).withColumn("v", verdict()["category"]).groupBy("validator", "uid").agg(F.max(F.when(F.col("v") == "NET", 100.0).otherwise(0.0)).alias("net"))
    q = quantiles(o.groupBy("validator", (F.col("uid") % 10).alias("unit")).agg(F.avg("net").alias("pct")), ["validator"], "pct", {"med": 0.5})
    n = o.groupBy("validator").agg(F.avg("net").alias("all")).join(q, "validator")
    return n.select("validator", F.round("all", 4).alias("overall"), F.round("med", 4).alias("median_unit"), ((F.col("all") > 5) & (F.col("med") > 5)).alias("substantial"))


@r.query(
    "kappa",
    """WITH k AS (SELECT quality AS a, toxic AS b FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL), n AS (SELECT count(*) AS n, count(*) FILTER (WHERE a = b) AS same FROM k),
       e AS (SELECT sum(x.c * y.c) AS prod FROM (SELECT a, count(*) AS c FROM k GROUP BY a) x JOIN (SELECT b, count(*) AS c FROM k GROUP BY b) y ON x.a = y.b)
       SELECT n, same / n AS agreement, prod / (n * n) AS expected, CASE WHEN prod / (n * n) < 1 THEN (same / n - prod / (n * n)) / (1 - prod / (n * n)) END AS kappa FROM n, e""",
)
def kappa(spark, sf_dir):
    """SET13."""
    return kappa_of(read_table(spark, sf_dir, "labels"), "quality", "toxic")


@r.query("consensus", f"WITH {CLASSED} SELECT DISTINCT validator, family, {VERDICT_SQL} AS first, {SECOND_SQL} AS second, CASE WHEN {VERDICT_SQL} = {SECOND_SQL} THEN {VERDICT_SQL} ELSE 'UNDECIDABLE' END AS consensus FROM m")
def consensus(spark, sf_dir):
    """SET14."""
    f = msg(spark, sf_dir).select("validator", "family").distinct().select("validator", "family", verdict()["category"].alias("first"), second().alias("second"))
    return f.withColumn("consensus", F.when(F.col("first") == F.col("second"), F.col("first")).otherwise("UNDECIDABLE"))


@r.query(
    "two_pass_net",
    f"""WITH {CLASSED}, v AS (SELECT uid, {VERDICT_SQL} = 'NET' AS n1, {SECOND_SQL} = 'NET' AS n2 FROM m), o AS (SELECT uid, bool_or(n1) AS p1, bool_or(n2) AS p2, bool_or(n1 AND n2) AS c FROM v GROUP BY uid),
        u AS (SELECT uid % 10 AS unit, count(*) AS n, count(*) FILTER (WHERE c) AS k FROM o GROUP BY 1)
        SELECT count(*) AS objects, count(*) FILTER (WHERE p1) AS net1, count(*) FILTER (WHERE p2) AS net2, count(*) FILTER (WHERE c) AS net_consensus, (SELECT count(*) FROM u WHERE k = 0) AS units_0, (SELECT count(*) FROM u WHERE k = n) AS units_100 FROM o""",
)
def two_pass_net(spark, sf_dir):
    """SET15."""
    m = msg(spark, sf_dir).withColumn("n1", verdict()["category"] == "NET").withColumn("n2", second() == "NET")
    o = m.groupBy("uid").agg(F.bool_or("n1").alias("p1"), F.bool_or("n2").alias("p2"), F.bool_or(F.expr("n1 AND n2")).alias("c"))
    u = o.groupBy((F.col("uid") % 10).alias("unit")).agg(F.count("*").alias("n"), F.count_if("p1").alias("p1"), F.count_if("p2").alias("p2"), F.count_if("c").alias("k"))
    return u.agg(F.sum("n").alias("objects"), F.sum("p1").alias("net1"), F.sum("p2").alias("net2"), F.sum("k").alias("net_consensus"), F.count_if(F.col("k") == 0).alias("units_0"), F.count_if(F.col("k") == F.col("n")).alias("units_100"))


@r.query("confusion", f"WITH {CLASSED}, v AS (SELECT DISTINCT validator, family, {VERDICT_SQL} = 'NET' AS a, {SECOND_SQL} = 'NET' AS b FROM m) SELECT count(*) FILTER (WHERE a AND b) AS both, count(*) FILTER (WHERE a AND NOT b) AS first_only, count(*) FILTER (WHERE b AND NOT a) AS second_only, count(*) FILTER (WHERE NOT a AND NOT b) AS neither FROM v")
def confusion(spark, sf_dir):
    """SET16."""
    v = msg(spark, sf_dir).select("validator", "family").distinct().select((verdict()["category"] == "NET").alias("a"), (second() == "NET").alias("b"))
    return v.agg(*[F.count_if(F.expr(e)).alias(n) for n, e in (("both", "a AND b"), ("first_only", "a AND NOT b"), ("second_only", "b AND NOT a"), ("neither", "NOT a AND NOT b"))])


@r.query(
    "table_equal",
    """WITH a AS (SELECT l_orderkey AS k, l_returnflag AS f FROM lineitem WHERE l_linenumber <= 6), b AS (SELECT l_orderkey AS k, l_returnflag AS f FROM lineitem WHERE l_linenumber >= 2),
       x AS (SELECT *, 'first' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'second' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)),
       d AS (SELECT concat(k, '|', f) AS shown, side FROM x ORDER BY k, f, side LIMIT 1)
       SELECT count(*) FILTER (WHERE side = 'first') AS only_first, count(*) FILTER (WHERE side = 'second') AS only_second, count(*) = 0 AS equal, (SELECT shown FROM d) AS first_difference, (SELECT side FROM d) AS side FROM x""",
)
def table_equal(spark, sf_dir):
    """SET17: two builds as bags, and the first row in which they differ."""
    l = read_table(spark, sf_dir, "lineitem")  # noqa: E741
    pick = lambda c: l.filter(c).select(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("f"))
    return M.table_difference(pick("l_linenumber <= 6"), pick("l_linenumber >= 2"))


@r.query(
    "two_pass_compare",
    f"""WITH {CLASSED}, f AS (SELECT DISTINCT class, validator, cid, family FROM m)
        SELECT class, validator, cid, family, {VERDICT_SQL} AS adjudication1, {SECOND_SQL} AS adjudication2, contains(family, 'retired') OR contains(family, 'frame') AS pre_disclosed, {VERDICT_SQL} = 'NET' AS net1, {SECOND_SQL} = 'NET' AS net2 FROM f""",
)
def two_pass_compare(spark, sf_dir):
    """SET18."""
    f = msg(spark, sf_dir).select("class", "validator", "cid", "family").distinct()
    out = f.withColumn("adjudication1", verdict()["category"]).withColumn("adjudication2", second()).withColumn("pre_disclosed", R.contains_any(F.col("family"), ["retired", "frame"]))
    return out.withColumn("net1", F.col("adjudication1") == "NET").withColumn("net2", F.col("adjudication2") == "NET")


@r.query(
    "corpus_context",
    f"""WITH {CLASSED}, g AS (SELECT * FROM (SELECT DISTINCT cid FROM m), (SELECT class, count(DISTINCT uid) AS denominator FROM m GROUP BY class)), n AS (SELECT cid, class, count(DISTINCT uid) AS objects FROM m GROUP BY ALL)
        SELECT cid, class, coalesce(objects, 0) AS objects, denominator FROM g LEFT JOIN n USING (cid, class)""",
)
def corpus_context(spark, sf_dir):
    """JOI5: objects of each class with a denominator, zeros shown. The grid is what is asked for; its side of types is
    sent to all tasks if it is counted to be short."""
    m = msg(spark, sf_dir)
    types = materialise(m.groupBy("class").agg(F.count_distinct("uid").alias("denominator")), "types")
    short = types.limit(10_001).count() <= 10_000
    g = m.select("cid").distinct().join(F.broadcast(types) if short else types)
    n = m.groupBy("cid", "class").agg(F.count_distinct("uid").alias("objects"))
    return g.join(n, ["cid", "class"], "left").fillna(0, ["objects"]).select("cid", "class", "objects", "denominator")


@r.query(
    "corroboration",
    f"""WITH {CLASSED}, st AS (SELECT DISTINCT uid, a AS attribute, CASE WHEN (uid + length(a)) % 3 = 0 THEN 'absent' WHEN (uid + length(a)) % 3 = 1 THEN 'empty' END AS state FROM msg, (SELECT unnest(['error', 'click', 'view']) AS a)),
        h AS (SELECT attribute, state, validator, uid, EXISTS (SELECT 1 FROM m WHERE m.uid = st.uid AND m.validator = t.validator AND contains(m.template, st.attribute)) AS hit FROM st, (SELECT unnest(['alpha', 'beta', 'gamma']) AS validator) t WHERE state IS NOT NULL)
        SELECT attribute, state, validator, count(*) FILTER (WHERE hit) AS raised, count(*) FILTER (WHERE NOT hit) AS silent FROM h GROUP BY ALL""",
)
def corroboration(spark, sf_dir):
    """JOI7: for each attribute in a state that is at fault, did a tool raise a matching message."""
    m = msg(spark, sf_dir)
    a = F.explode(F.array(F.lit("error"), F.lit("click"), F.lit("view")))
    which = (F.col("uid") + F.length("attribute")) % 3
    states = m.select("uid").distinct().select("uid", a.alias("attribute")).withColumn("state", F.when(which == 0, "absent").when(which == 1, "empty")).filter("state IS NOT NULL")
    return M.corroboration(states, m, "uid", ["alpha", "beta", "gamma"])


@r.query(
    "cross_tool_bound",
    f"""WITH {CLASSED}, c AS (SELECT class, validator, cid, count(DISTINCT uid) AS n FROM m WHERE upper(severity) = 'ERROR' GROUP BY ALL), x AS (SELECT class, validator, max(n) AS most FROM c GROUP BY ALL), t AS (SELECT class, validator, count(DISTINCT uid) AS total FROM m GROUP BY ALL)
        SELECT validator, sum(coalesce(most, 0))::BIGINT AS lower_bound, sum(total)::BIGINT AS total, bool_and(most IS NULL OR most = total) AS exact FROM t LEFT JOIN x USING (class, validator) GROUP BY validator""",
)
def cross_tool_bound(spark, sf_dir):
    """JOI8: at least as many objects as the commonest class of each cell."""
    m = msg(spark, sf_dir)
    most = m.filter(F.upper("severity") == "ERROR").groupBy("class", "validator", "cid").agg(F.count_distinct("uid").alias("n")).groupBy("class", "validator").agg(F.max("n").alias("most"))
    t = m.groupBy("class", "validator").agg(F.count_distinct("uid").alias("total")).join(most, ["class", "validator"], "left")
    return t.groupBy("validator").agg(F.sum(F.coalesce("most", F.lit(0))).alias("lower_bound"), F.sum("total").alias("total"), F.bool_and(F.col("most").isNull() | (F.col("most") == F.col("total"))).alias("exact"))
