"""Nested records: objects with segments and macro items, recoverability, and joins over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditspark.functions import rules as R
from auditspark.functions import stats as S
from auditspark.functions.stats import percent
from auditspark.operators import census as C
from auditspark.operators.graph import cycles, paths
from auditspark.plans.archive import KNOWN
from auditspark.plans.statistics import wilson_sql
from auditspark.plans.vocabulary import PRODUCT_RULES, VERSION, case_sql, sql_list
from auditspark.plans.views import Registry, view
from auditspark.session import materialise, read_table

r = Registry()
QUERIES, ORACLES = r.queries, r.oracles

STATES = ["absent", "present_zero_items", "present_incomplete", "present_complete"]


def seg(spark, sf_dir):
    return view(spark, sf_dir, "seg")


def nested(spark, sf_dir):
    """Objects with their segments as an array; an object's segments belong together, and are few."""
    items = F.struct("number", "part", "kind", "identification", "non_manual", "tool", "tool_version", "price", "quantity")
    return seg(spark, sf_dir).groupBy("uid").agg(F.array_sort(F.collect_list(items)).alias("segments"))


def _in_state(v):
    return lambda x: x.identification == v


@r.query(
    "segment_rollup",
    f"""SELECT uid, count(*)::INTEGER AS n, bool_or(non_manual) AS any_non_manual, bool_and(non_manual) AS all_non_manual, {', '.join(f"count(*) FILTER (WHERE identification = '{s}')::INTEGER AS {s}" for s in STATES)},
        coalesce(bool_and(identification = 'present_complete') FILTER (WHERE non_manual), true) AS complete FROM seg GROUP BY uid""",
)
def segment_rollup(spark, sf_dir):
    """AGG33: quantifiers over an object's segments, on the array itself."""
    s = F.col("segments")
    non = F.filter(s, lambda x: x.non_manual)
    return nested(spark, sf_dir).select(
        "uid",
        F.size(s).alias("n"),
        F.exists(s, lambda x: x.non_manual).alias("any_non_manual"),
        F.forall(s, lambda x: x.non_manual).alias("all_non_manual"),
        *[F.size(F.filter(s, _in_state(v))).alias(v) for v in STATES],
        F.forall(non, lambda x: x.identification == "present_complete").alias("complete"),
    )


@r.query(
    "type_of_segment",
    """SELECT uid, CASE WHEN count(*) FILTER (WHERE tool IS NULL OR trim(tool) = '' OR tool_version IS NULL OR trim(tool_version) = '') > 0 THEN 'present_incomplete' ELSE 'present_complete' END AS state,
       concat_ws(',', CASE WHEN count(*) FILTER (WHERE tool IS NULL OR trim(tool) = '') > 0 THEN 'tool' END, CASE WHEN count(*) FILTER (WHERE tool_version IS NULL OR trim(tool_version) = '') > 0 THEN 'tool_version' END) AS missing FROM seg GROUP BY uid""",
)
def type_of_segment(spark, sf_dir):
    """CLS14: the state of a nested item sequence, with the mandatory members missing."""
    return nested(spark, sf_dir).withColumn("m", R.macro_state(F.col("segments"), ["tool", "tool_version"])).select("uid", "m.state", F.array_join("m.missing", ",").alias("missing"))


@r.query(
    "segment_level",
    f"""WITH c AS (SELECT kind, identification, count(*) AS k, count(DISTINCT uid) AS series FROM seg WHERE non_manual GROUP BY ALL), t AS (SELECT *, sum(k) OVER (PARTITION BY kind)::BIGINT AS n FROM c)
        SELECT kind, identification, k, n, series, CASE WHEN n < 30 THEN 'counts only' WHEN n < 384 THEN 'flagged' ELSE 'rate' END AS rule, {wilson_sql('k', 'n')} FROM t""",
)
def segment_level(spark, sf_dir):
    """AGG34 by segments."""
    c = seg(spark, sf_dir).filter("non_manual").groupBy("kind", "identification").agg(F.count("*").alias("k"), F.count_distinct("uid").alias("series"))
    t = c.withColumn("n", F.sum("k").over(C.Window.partitionBy("kind")))
    w = S.wilson(F.col("k"), F.col("n"))
    return t.select("kind", "identification", "k", "n", "series", S.reporting_rule(F.col("n")).alias("rule"), F.round(w["lo"], 6).alias("lo"), F.round(w["hi"], 6).alias("hi"))


@r.query("object_level", f"WITH o AS (SELECT kind, uid, bool_or(identification = 'present_complete') AS ok FROM seg WHERE non_manual GROUP BY ALL), t AS (SELECT kind, count(*) AS n, count(*) FILTER (WHERE ok) AS k FROM o GROUP BY kind) SELECT kind, k, n, {wilson_sql('k', 'n')} FROM t")
def object_level(spark, sf_dir):
    """AGG34 by objects."""
    o = seg(spark, sf_dir).filter("non_manual").groupBy("kind", "uid").agg(F.bool_or(F.col("identification") == "present_complete").alias("ok"))
    t = o.groupBy("kind").agg(F.count("*").alias("n"), F.count_if("ok").alias("k"))
    w = S.wilson(F.col("k"), F.col("n"))
    return t.select("kind", "k", "n", F.round(w["lo"], 6).alias("lo"), F.round(w["hi"], 6).alias("hi"))


@r.query("identification_by_writer", "SELECT tool, kind, identification, count(*) AS segments, count(DISTINCT uid) AS objects FROM seg WHERE non_manual GROUP BY ALL")
def identification_by_writer(spark, sf_dir):
    """AGG28."""
    return seg(spark, sf_dir).filter("non_manual").groupBy("tool", "kind", "identification").agg(F.count("*").alias("segments"), F.count_distinct("uid").alias("objects"))


@r.query("contradiction", "SELECT kind, line_status, count(*) AS segments, count(DISTINCT uid) AS objects FROM seg WHERE NOT non_manual AND identification = 'present_complete' GROUP BY ALL")
def contradiction(spark, sf_dir):
    """AGG29: a complete identification on what says it is manual."""
    return seg(spark, sf_dir).filter("NOT non_manual AND identification = 'present_complete'").groupBy("kind", "line_status").agg(F.count("*").alias("segments"), F.count_distinct("uid").alias("objects"))


@r.query("map_counts", "SELECT line_status, kind AS value, count(*) AS n FROM seg GROUP BY ALL")
def map_counts(spark, sf_dir):
    """AGG35: value counts held as maps per object, summed again."""
    per = seg(spark, sf_dir).groupBy("uid", "line_status", "kind").agg(F.count("*").alias("n")).groupBy("uid", "line_status").agg(F.map_from_entries(F.collect_list(F.struct("kind", "n"))).alias("kinds"))
    return per.select("line_status", F.explode("kinds").alias("value", "n")).groupBy("line_status", "value").agg(F.sum("n").alias("n"))


@r.query("macro_content", "SELECT tool, tool_version, count(*) AS n, count(DISTINCT uid) AS objects FROM seg WHERE tool IS NOT NULL OR tool_version IS NOT NULL GROUP BY ALL")
def macro_content(spark, sf_dir):
    """AGG36: distinct macro tuples out of the nested arrays."""
    m = nested(spark, sf_dir).select("uid", F.explode(F.filter("segments", lambda x: x.tool.isNotNull() | x.tool_version.isNotNull())).alias("m"))
    return m.groupBy("m.tool", "m.tool_version").agg(F.count("*").alias("n"), F.count_distinct("uid").alias("objects"))


@r.query(
    "out_of_enumeration",
    "WITH f AS (SELECT DISTINCT uid FROM msg WHERE contains(message, 'not allowed')) SELECT s.tool AS value, count(*) AS segments, count(DISTINCT s.uid) AS objects, count(DISTINCT f.uid) AS flagged FROM seg s LEFT JOIN f ON f.uid = s.uid WHERE s.tool NOT IN ('tool 1', 'tool 2', 'tool 3', '') GROUP BY s.tool",
)
def out_of_enumeration(spark, sf_dir):
    """AGG37: values outside an enumeration, and on how many of their objects a tool said so."""
    flagged = view(spark, sf_dir, "msg").filter(F.contains("message", F.lit("not allowed"))).select("uid").distinct().withColumn("f", F.col("uid"))
    bad = seg(spark, sf_dir).filter(~F.col("tool").isin("tool 1", "tool 2", "tool 3", ""))
    return bad.join(flagged, "uid", "left").groupBy(F.col("tool").alias("value")).agg(F.count("*").alias("segments"), F.count_distinct("uid").alias("objects"), F.count_distinct("f").alias("flagged"))


@r.query("first_exemplar", "SELECT kind, identification, arg_min(uid, uid * 10 + number) AS uid, arg_min(number, uid * 10 + number) AS number, count(*) AS n FROM seg WHERE non_manual GROUP BY ALL")
def first_exemplar(spark, sf_dir):
    """FIL9: the first qualifying nested item for each key."""
    order = F.struct("uid", "number")
    return seg(spark, sf_dir).filter("non_manual").groupBy("kind", "identification").agg(F.min(order).alias("m"), F.count("*").alias("n")).select("kind", "identification", "m.uid", "m.number", "n")


NAMED = f"{case_sql('lower(trim(v))', PRODUCT_RULES, 0, chr(39) + 'x' + chr(39))} = 'named'"
LEVELS = [("equipment attributes", True), ("file meta", True), ("description", True), ("in-object carriers", True), ("collection metadata", False)]
#: (level, use) -> columns of the index, of the segments
INDEX_CARRIERS = {(1, "identity"): ["maker", "model"], (1, "version"): ["model"], (2, "identity"): ["syntax"], (2, "version"): ["syntax"], (3, "identity"): ["description"], (3, "version"): ["description"], (5, "identity"): ["collection", "analysis", "doi"]}
SEGMENT_CARRIERS = {(4, "identity"): ["tool"], (4, "version"): ["tool_version"]}


def _carried(table: str, carriers: dict) -> str:
    return " UNION ALL ".join(f"SELECT class, analysis, {level} AS level, '{use}' AS use, {c} AS v FROM {table}" for (level, use), columns in carriers.items() for c in columns)


@r.query(
    "recoverability_ladder",
    f"""WITH ix AS (SELECT class, {KNOWN} AS analysis, collection, doi, maker, model, syntax, description, uid FROM idx), sx AS (SELECT class, analysis, tool, tool_version FROM seg JOIN ix USING (uid)),
        l AS (SELECT * FROM ({_carried("ix", INDEX_CARRIERS)} UNION ALL {_carried("sx", SEGMENT_CARRIERS)}) WHERE trim(v) <> ''),
        p AS (SELECT class, analysis, level, min(v) FILTER (WHERE use = 'identity' AND {NAMED}) AS producer, min(v) FILTER (WHERE use = 'version' AND regexp_matches(v, '{VERSION}')) AS vin FROM l GROUP BY ALL),
        q AS (SELECT *, coalesce(vin, CASE WHEN regexp_matches(producer, '{VERSION}') THEN producer END) AS version_in, row_number() OVER (PARTITION BY class, analysis ORDER BY level) AS rn FROM p WHERE producer IS NOT NULL),
        o AS (SELECT class, analysis, count(*) AS objects FROM ix GROUP BY ALL), y AS (SELECT class, analysis, {", ".join(f"bool_or(level = {k}) AS level{k}" for k in range(1, 6))} FROM q GROUP BY ALL)
        SELECT o.class, o.analysis, objects, level::INTEGER AS first_level, CASE level {" ".join(f"WHEN {k + 1} THEN '{name}'" for k, (name, _) in enumerate(LEVELS))} ELSE 'appears at no level' END AS level_name, producer,
          regexp_extract(version_in, '{VERSION}') AS version, version_in, CASE WHEN level IS NULL THEN 'appears nowhere' WHEN level = 5 THEN 'no, registry only' ELSE 'yes' END AS in_object, {", ".join(f"coalesce(level{k}, false) AS level{k}" for k in range(1, 6))}
        FROM o LEFT JOIN (SELECT * FROM q WHERE rn = 1) USING (class, analysis) LEFT JOIN y USING (class, analysis)""",
)
def recoverability_ladder(spark, sf_dir):
    """AGG27: the first of five levels at which a producer is named. Segments are reduced to their distinct values
    per object before they meet the index."""
    ix = view(spark, sf_dir, "idx").withColumn("analysis", C.known_id(F.col("analysis")))
    s = seg(spark, sf_dir).select("uid", "tool", "tool_version").distinct().join(ix.select("uid", "class", "analysis"), "uid")

    def carried(df: DataFrame, carriers: dict) -> DataFrame:
        held = F.array(*[F.struct(F.lit(level).alias("level"), F.lit(use).alias("use"), F.col(c).alias("value")) for (level, use), columns in carriers.items() for c in columns])
        return df.select("class", "analysis", F.explode(held).alias("h")).select("class", "analysis", "h.*")

    named = R.classify(F.col("value"), PRODUCT_RULES)["category"] == "named"
    return C.recoverability(ix, carried(ix, INDEX_CARRIERS).unionByName(carried(s, SEGMENT_CARRIERS)), ["class", "analysis"], LEVELS, named, VERSION)


@r.query(
    "equipment_spread",
    "SELECT part, count(DISTINCT tool) AS tools, count(*) AS segments, string_agg(DISTINCT tool, ', ' ORDER BY tool) AS named FROM seg WHERE trim(tool) <> '' GROUP BY part HAVING count(DISTINCT tool) > 1",
)
def equipment_spread(spark, sf_dir):
    """AGG39: parts that more than one tool worked on."""
    return seg(spark, sf_dir).filter(F.trim("tool") != "").groupBy("part").agg(F.count_distinct("tool").alias("tools"), F.count("*").alias("segments"), C.joined(F.col("tool"), ", ").alias("named")).filter("tools > 1")


@r.query(
    "silent_exemplars",
    """WITH o AS (SELECT i.class, i.collection, s.uid, bool_or(s.non_manual) AS usable, bool_or(NOT s.non_manual AND s.identification = 'present_complete') AS odd, bool_or(trim(s.tool) <> '') AS named, min(s.line_status) AS v FROM seg s JOIN idx i USING (uid) GROUP BY ALL),
       c AS (SELECT class, collection FROM o GROUP BY ALL HAVING count(*) FILTER (WHERE named) < 0.97 * count(*)),
       n AS (SELECT class, collection, v, count(*) AS k FROM o WHERE NOT coalesce(named, false) GROUP BY ALL)
       SELECT o.class, o.collection, count(*) FILTER (WHERE NOT coalesce(named, false)) AS silent, count(*) FILTER (WHERE NOT coalesce(named, false) AND usable AND NOT odd) AS usable, count(*) FILTER (WHERE NOT coalesce(named, false) AND NOT usable AND NOT odd) AS all_manual, count(*) FILTER (WHERE NOT coalesce(named, false) AND odd) AS contradictory,
         (SELECT concat(arg_min(v, -k * 1000 + ascii(v)), ' +', count(*) - 1, ' more') FROM n WHERE n.class = o.class AND n.collection = o.collection) AS top_value
       FROM o JOIN c USING (class, collection) GROUP BY o.class, o.collection""",
)
def silent_exemplars(spark, sf_dir):
    """AGG42: cells where too little is named, split by why."""
    i = view(spark, sf_dir, "idx").select("uid", "class", "collection")
    o = seg(spark, sf_dir).join(i, "uid").groupBy("class", "collection", "uid").agg(F.bool_or("non_manual").alias("usable"), F.bool_or(~F.col("non_manual") & (F.col("identification") == "present_complete")).alias("odd"), F.coalesce(F.bool_or(F.trim("tool") != ""), F.lit(False)).alias("named"), F.min("line_status").alias("v"))
    s = ~F.col("named")
    cells = o.groupBy("class", "collection").agg(F.count("*").alias("n"), F.count_if("named").alias("k"), F.count_if(s).alias("silent"), F.count_if(s & F.col("usable") & ~F.col("odd")).alias("usable"), F.count_if(s & ~F.col("usable") & ~F.col("odd")).alias("all_manual"), F.count_if(s & F.col("odd")).alias("contradictory")).filter("k < 0.97 * n")
    n = o.filter(s).groupBy("class", "collection", "v").agg(F.count("*").alias("k")).groupBy("class", "collection").agg(F.concat(F.min_by("v", F.struct(-F.col("k"), "v")), F.lit(" +"), (F.count("*") - 1).cast("string"), F.lit(" more")).alias("top_value"))
    return cells.join(n, ["class", "collection"], "left").select("class", "collection", "silent", "usable", "all_manual", "contradictory", "top_value")


@r.query(
    "file_meta_writer",
    """WITH o AS (SELECT uid, min(tool) FILTER (WHERE trim(tool) <> '') AS name, bool_or(tool_version = 'v1.1') AS v1, bool_or(tool_version = 'v2.1') AS v2 FROM seg GROUP BY uid)
       SELECT uid, CASE WHEN uid % 10 = 3 AND v2 THEN 'inconsistent' WHEN uid % 10 = 3 THEN 'uid writer' WHEN v2 THEN 'version writer' WHEN v1 THEN 'item writer' WHEN name IS NULL THEN 'none' ELSE concat('unresolved ', uid % 10, ' / ', name) END AS writer FROM o""",
)
def file_meta_writer(spark, sf_dir):
    """CLS5: identity by uid against identity by version, then nested items."""
    has = lambda v: F.exists("segments", lambda x: x.tool_version.eqNullSafe(F.lit(v)))
    name = F.array_min(F.transform(F.filter("segments", lambda x: F.trim(x.tool) != ""), lambda x: x.tool))
    by_uid = F.col("uid") % 10 == 3
    w = F.when(by_uid & has("v2.1"), "inconsistent").when(by_uid, "uid writer").when(has("v2.1"), "version writer").when(has("v1.1"), "item writer").when(name.isNull(), "none").otherwise(F.concat(F.lit("unresolved "), (F.col("uid") % 10).cast("string"), F.lit(" / "), name))
    return nested(spark, sf_dir).select("uid", w.alias("writer"))


@r.query(
    "enrich_left",
    "WITH l(class, label) AS (VALUES ('1-URGENT', 'first'), ('2-HIGH', 'second')) SELECT i.class, label, count(*) AS series FROM idx i LEFT JOIN l USING (class) GROUP BY ALL",
)
def enrich_left(spark, sf_dir):
    """JOI1: the aggregate meets the label list, not the rows."""
    n = view(spark, sf_dir, "idx").groupBy("class").agg(F.count("*").alias("series"))
    label = F.element_at(F.create_map(F.lit("1-URGENT"), F.lit("first"), F.lit("2-HIGH"), F.lit("second")), F.col("class"))
    return n.select("class", label.alias("label"), "series")


@r.query(
    "verify_expected",
    "WITH e AS (SELECT p_partkey AS k, p_type AS expected FROM part), a AS (SELECT part AS k, min(line_status) AS seen FROM seg GROUP BY part) SELECT e.k, expected, coalesce(seen, 'NOT FOUND') AS seen FROM e LEFT JOIN a USING (k)",
)
def verify_expected(spark, sf_dir):
    """JOI9."""
    e = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_type").alias("expected"))
    a = seg(spark, sf_dir).groupBy(F.col("part").alias("k")).agg(F.min("line_status").alias("seen"))
    return e.join(a, "k", "left").fillna("NOT FOUND", ["seen"])


EDGES = "SELECT p_partkey AS child, CASE WHEN p_partkey < 5 THEN NULL ELSE p_partkey // 5 END AS parent, p_type AS kind FROM part"


@r.query(
    "nested_path_find",
    f"""WITH RECURSIVE e AS ({EDGES}), t AS (SELECT child, CAST(child AS VARCHAR) AS path, 0 AS depth, kind FROM e WHERE parent IS NULL UNION ALL SELECT e.child, concat(t.path, '/', e.child), t.depth + 1, e.kind FROM t JOIN e ON e.parent = t.child WHERE e.child <> e.parent)
        SELECT child, path, depth, kind FROM t""",
)
def nested_path_find(spark, sf_dir):
    """JOI10: paths to all keys of nested definitions."""
    sql = EDGES.replace("//", "DIV").replace("FROM part", "FROM {part}")
    edges = materialise(spark.sql(sql, part=read_table(spark, sf_dir, "part")), "edges")
    return paths(edges, "child", "parent").join(edges.select("child", "kind"), F.col("node") == F.col("child")).select("child", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"), "depth", "kind")


#: Parts that contain others, by two rules that make diamonds, and, for some, cycles.
LINKS = "SELECT p_partkey AS child, CASE WHEN p_partkey % 50 < 2 THEN NULL ELSE p_partkey - 1 - p_partkey % 3 END AS parent FROM part UNION ALL SELECT p_partkey, p_partkey - 2 FROM part WHERE p_partkey % 50 BETWEEN 3 AND 12 UNION ALL SELECT p_partkey - p_partkey % 7, p_partkey FROM part WHERE p_partkey % 350 BETWEEN 43 AND 45"


@r.query(
    "nested_paths",
    f"""WITH RECURSIVE e AS (SELECT DISTINCT child, parent FROM ({LINKS})), t AS (SELECT child, [child] AS path FROM e WHERE parent IS NULL UNION ALL SELECT e.child, list_append(t.path, e.child) FROM t JOIN e ON e.parent = t.child WHERE NOT list_contains(t.path, e.child))
        SELECT child, array_to_string(path, '/') AS path, len(path)::INTEGER - 1 AS depth FROM t""",
)
def nested_paths(spark, sf_dir):
    """JOI10 where keys have several parents: each path once, none through a cycle."""
    edges = spark.sql(LINKS.replace("FROM part", "FROM {part}"), part=read_table(spark, sf_dir, "part"))
    return paths(edges, "child", "parent").select(F.col("node").alias("child"), F.array_join(F.col("path").cast("array<string>"), "/").alias("path"), "depth")


@r.query(
    "nested_cycles",
    f"""WITH RECURSIVE e AS (SELECT DISTINCT child, parent FROM ({LINKS}) WHERE parent IS NOT NULL), t AS (SELECT child AS start, parent AS at_ FROM e UNION SELECT t.start, e.parent FROM t JOIN e ON e.child = t.at_)
        SELECT DISTINCT start AS node FROM t WHERE start = at_""",
)
def nested_cycles(spark, sf_dir):
    """JOI10: keys that contain themselves."""
    edges = spark.sql(LINKS.replace("FROM part", "FROM {part}"), part=read_table(spark, sf_dir, "part"))
    return cycles(edges, "child", "parent")


USAGE = "CASE p_size % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'U' ELSE 'C' END"
ATTRIBUTES = ["red", "blue", "small", "large"]


@r.query(
    "module_table",
    f"""WITH m AS (SELECT p_type AS type, p_brand AS module, {USAGE} AS usage, split_part(p_name, ' ', 1) AS attribute, p_size FROM part WHERE p_brand LIKE 'Brand#1%'), t AS (SELECT p_type AS type FROM part UNION SELECT 'NO SUCH TYPE')
        SELECT t.type, coalesce(module, 'TYPE NOT FOUND') AS module, coalesce(usage, '') AS usage, {", ".join(f"CASE WHEN module IS NULL THEN '' ELSE coalesce(min(p_size) FILTER (WHERE attribute = '{a}')::VARCHAR, 'not in module') END AS {a}" for a in ATTRIBUTES)} FROM t LEFT JOIN m ON m.type = t.type GROUP BY t.type, module, usage""",
)
def module_table(spark, sf_dir):
    """JOI11: each measured type's modules of interest with their usage, and what each attribute is in them."""
    p = read_table(spark, sf_dir, "part")
    held = p.filter("p_brand LIKE 'Brand#1%'").select(F.col("p_type").alias("type"), F.col("p_brand").alias("module"), F.expr(USAGE).alias("usage"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("attribute"), F.col("p_size").cast("string").alias("kind"), F.col("p_size").alias("order"))
    types = p.select(F.col("p_type").alias("type")).union(spark.range(1).select(F.lit("NO SUCH TYPE"))).distinct()
    return C.module_table(types, held, ATTRIBUTES)


@r.query(
    "module_usage",
    "WITH m AS (SELECT p_type AS type, p_brand AS module, CASE p_size % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'U' ELSE 'C' END AS usage, p_name AS attribute FROM part) SELECT type, count(DISTINCT module) FILTER (WHERE usage = 'M') AS mandatory_modules, count(DISTINCT attribute) FILTER (WHERE usage = 'M') AS mandatory_attributes, count(DISTINCT attribute) AS attributes FROM m GROUP BY type",
)
def module_usage(spark, sf_dir):
    """JOI11."""
    p = read_table(spark, sf_dir, "part")
    m = p.select(F.col("p_type").alias("type"), F.col("p_brand").alias("module"), (F.col("p_size") % 3 == 0).alias("mandatory"), F.col("p_name").alias("attribute"))
    only = lambda c: F.count_distinct(F.when(F.col("mandatory"), F.col(c)))
    return m.groupBy("type").agg(only("module").alias("mandatory_modules"), only("attribute").alias("mandatory_attributes"), F.count_distinct("attribute").alias("attributes"))
