"""Filters, censuses and distributions over the archive's index."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditspark.functions import rules as R
from auditspark.functions import text as X
from auditspark.functions.stats import percent
from auditspark.operators import census as C
from auditspark.plans.vocabulary import (
    BUCKETS,
    CONVENTION_STOP,
    EXTRA_RULES,
    GENERIC,
    PRODUCT_RULES,
    SENTINELS,
    VERSION,
    WRITER_RULES,
    case_sql,
    sql_list,
)
from auditspark.plans.views import Registry, view
from auditspark.session import read_table

r = Registry()
QUERIES, ORACLES = r.queries, r.oracles

DERIVED = ["1-URGENT", "2-HIGH", "3-MEDIUM"]
ADJACENT = ["4-NOT SPECIFIED"]
KNOWN = "coalesce(nullif(CASE WHEN lower(trim(analysis)) IN ('', 'nan', 'none', 'null') THEN NULL ELSE analysis END, ''), '(null)')"


def idx(spark, sf_dir):
    return view(spark, sf_dir, "idx")


def tag():
    c = F.col("class")
    return F.when(c.isin(*DERIVED), "derived").when(c.isin(*ADJACENT), "adjacent").otherwise("acquired")


TAG = f"CASE WHEN class IN ({sql_list(DERIVED)}) THEN 'derived' WHEN class IN ({sql_list(ADJACENT)}) THEN 'adjacent' ELSE 'acquired' END"


@r.query("scan_index", "SELECT count(*) AS n_rows, count(DISTINCT o_orderkey) AS n_keys, count(*) = count(DISTINCT o_orderkey) AS is_unique FROM orders")
def scan_index(spark, sf_dir):
    """SRC1: the index, and whether it has one row per key."""
    df = read_table(spark, sf_dir, "orders")
    return df.agg(F.count("*").alias("n_rows"), F.count_distinct("o_orderkey").alias("n_keys")).withColumn("is_unique", F.col("n_rows") == F.col("n_keys"))


@r.query("derived", f"SELECT class, count(*) AS series FROM idx WHERE class IN ({sql_list(DERIVED + ADJACENT)}) GROUP BY class")
def derived(spark, sf_dir):
    """FIL1: only the derived (and adjacent) classes."""
    return idx(spark, sf_dir).filter(F.col("class").isin(*DERIVED, *ADJACENT)).groupBy("class").agg(F.count("*").alias("series"))


@r.query("attributed", "SELECT class, count(*) AS series FROM idx WHERE analysis IS NOT NULL GROUP BY class")
def attributed(spark, sf_dir):
    """FIL2: the second denominator, rows with an analysis id."""
    return idx(spark, sf_dir).filter(F.col("analysis").isNotNull()).groupBy("class").agg(F.count("*").alias("series"))


@r.query(
    "two_denominators",
    """SELECT class, count(*) AS series, count(analysis) AS attributed, count(*) FILTER (WHERE licence LIKE '%NC%') AS flagged,
       count(*) FILTER (WHERE licence LIKE '%NC%' AND analysis IS NOT NULL) AS flagged_attributed,
       round(100.0 * count(*) FILTER (WHERE licence LIKE '%NC%') / count(*), 2) AS pct_all,
       round(100.0 * count(*) FILTER (WHERE licence LIKE '%NC%' AND analysis IS NOT NULL) / nullif(count(analysis), 0), 2) AS pct_attributed
       FROM idx GROUP BY class""",
)
def two_denominators(spark, sf_dir):
    """FIL3: one rate against both denominators."""
    flag, known = F.contains("licence", F.lit("NC")), F.col("analysis").isNotNull()
    n = F.count("*"), F.count("analysis"), F.count_if(flag), F.count_if(flag & known)
    return idx(spark, sf_dir).groupBy("class").agg(
        n[0].alias("series"), n[1].alias("attributed"), n[2].alias("flagged"), n[3].alias("flagged_attributed"), percent(n[2], n[0]).alias("pct_all"), percent(n[3], n[1]).alias("pct_attributed")
    )


@r.query("class_tag", f"SELECT {TAG} AS tag, class, count(*) AS series, sum(instances)::BIGINT AS instances FROM idx GROUP BY ALL")
def class_tag(spark, sf_dir):
    """FIL4: derived, adjacent or acquired."""
    return idx(spark, sf_dir).groupBy(tag().alias("tag"), "class").agg(F.count("*").alias("series"), F.sum("instances").alias("instances"))


@r.query(
    "needle_search",
    """WITH docs AS (SELECT doc_id AS id, 'text' AS attribute, text AS value, lang AS class FROM documents
         UNION ALL SELECT doc_id, 'source', source, lang FROM documents UNION ALL SELECT doc_id, 'lang', lang, lang FROM documents)
       SELECT attribute, class, count(DISTINCT id) AS hits, min(left(value, 40)) AS example FROM docs WHERE contains(lower(value), 'src1') OR contains(lower(value), 'apache')
       GROUP BY attribute, class""",
)
def needle_search(spark, sf_dir):
    """FIL6: which attributes hold a needle, per class, with an example."""
    docs = read_table(spark, sf_dir, "documents").withColumn("class", F.col("lang"))
    v = F.lower(F.col("value"))
    found = C.melt(docs, ["doc_id", "class"], ["text", "source", "lang"]).filter(R.contains_any(v, ["src1", "apache"]))
    return found.groupBy("attribute", "class").agg(F.count_distinct("doc_id").alias("hits"), F.min(F.substring("value", 1, 40)).alias("example"))


@r.query(
    "needle_coverage",
    f"SELECT column_name, column_name IN ('doc_id', 'text', 'lang', 'source') AS searched, filled FROM ({' UNION ALL '.join(f'SELECT {chr(39)}{c}{chr(39)} AS column_name, count({c}) AS filled FROM documents' for c in ('doc_id', 'text', 'lang', 'source', 'n_chars'))})",
)
def needle_coverage(spark, sf_dir):
    """FIL6: which columns a search covers and which it doesn't, and how many rows each has a value in."""
    docs = read_table(spark, sf_dir, "documents")
    n = docs.agg(*[F.count(c).alias(c) for c in docs.columns])
    long = n.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("filled")) for c in docs.columns])).alias("x")).select("x.*")
    return long.withColumn("searched", F.col("column_name").isin("doc_id", "text", "lang", "source"))


@r.query(
    "needle_values",
    """WITH v AS (SELECT o_orderkey AS uid, 'priority' AS attribute, o_orderpriority AS value FROM orders UNION ALL SELECT l_orderkey, 'lines.part', p_name FROM lineitem JOIN part ON p_partkey = l_partkey UNION ALL SELECT l_orderkey, 'lines.brand', p_brand FROM lineitem JOIN part ON p_partkey = l_partkey),
       n AS (SELECT attribute, value, count(DISTINCT uid) AS objects FROM v WHERE contains(lower(value), 'urgent') OR contains(lower(value), 'brand#1') OR contains(lower(value), 'part 1') GROUP BY ALL)
       SELECT attribute, value, objects, row_number() OVER (PARTITION BY attribute ORDER BY objects DESC, value)::INTEGER AS place FROM n QUALIFY place <= 5""",
)
def needle_values(spark, sf_dir):
    """FIL6: the search goes into nested items; the commonest values that hold a needle, for each attribute."""
    parts = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("part"), F.col("p_brand").alias("brand"))
    lines = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("uid"), "l_partkey").join(parts, "l_partkey").groupBy("uid").agg(F.collect_list(F.struct("part", "brand")).alias("lines"))
    records = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("uid"), F.col("o_orderpriority").alias("priority")).join(lines, "uid", "full_outer")
    return C.needle_values(records, "uid", {"priority": F.array("priority"), "lines.part": F.col("lines.part"), "lines.brand": F.col("lines.brand")}, ["urgent", "brand#1", "part 1"], 5)


@r.query(
    "exposure",
    """WITH c AS (SELECT class, unnest(list_filter([CASE WHEN mb > 250000 THEN 'large' END, CASE WHEN instances = 1 THEN 'single' END, CASE WHEN maker IS NULL THEN 'no maker' END], lambda x: x IS NOT NULL)) AS condition FROM idx),
       n AS (SELECT class, count(*) AS cell FROM idx GROUP BY class), t AS (SELECT count(*) AS whole FROM idx)
       SELECT c.class, condition, count(*) AS objects, round(100.0 * count(*) / any_value(cell), 2) AS pct_cell, round(100.0 * count(*) / any_value(whole), 2) AS pct_whole
       FROM c JOIN n USING (class), t GROUP BY c.class, condition""",
)
def exposure(spark, sf_dir):
    """FIL7: objects that meet named conditions, as shares of their cell and of all."""
    df = idx(spark, sf_dir)
    conditions = {"large": F.col("mb") > 250000, "single": F.col("instances") == 1, "no maker": F.col("maker").isNull()}
    cells = df.groupBy("class").agg(F.count("*").alias("cell"), *[F.count_if(c).alias(f"_{k}") for k, c in enumerate(conditions.values())])
    whole = df.agg(F.count("*").alias("whole"))
    long = cells.join(whole).select("class", "cell", "whole", F.explode(F.array(*[F.struct(F.lit(n).alias("condition"), F.col(f"_{k}").alias("objects")) for k, n in enumerate(conditions)])).alias("x"))
    return long.select("class", "x.condition", "x.objects", percent(F.col("x.objects"), F.col("cell")).alias("pct_cell"), percent(F.col("x.objects"), F.col("whole")).alias("pct_whole")).filter("objects > 0")


def _census(keys: str, where: str = "TRUE") -> str:
    return f"""SELECT {keys}, count(*) AS series, sum(instances)::BIGINT AS instances, round(sum(mb) / 1000, 3) AS gb, round(avg(mb), 3) AS mean_mb,
        count(DISTINCT collection) AS collections, count(DISTINCT patient) AS patients FROM idx WHERE {where} GROUP BY ALL"""


@r.query("census", f"WITH c AS ({_census(TAG + ' AS tag, class')}) SELECT *, round(100.0 * series / sum(series) OVER (PARTITION BY tag), 2) AS pct FROM c")
def census(spark, sf_dir):
    """AGG1, AGG3, FIL4: the census by class, each with its share of its tag."""
    return C.share_within(C.census(idx(spark, sf_dir).withColumn("tag", tag()), ["tag", "class"]), "series", ["tag"])


@r.query("census_by_collection", _census("collection"))
def census_by_collection(spark, sf_dir):
    return C.census(idx(spark, sf_dir), ["collection"])


@r.query(
    "census_by_analysis",
    f"WITH k AS (SELECT * REPLACE ({KNOWN} AS analysis) FROM idx), c AS ({_census('analysis').replace('FROM idx', 'FROM k')}), l AS (SELECT analysis, string_agg(DISTINCT class, ' | ' ORDER BY class) AS classes FROM k GROUP BY analysis) SELECT c.*, classes FROM c LEFT JOIN l USING (analysis)",
)
def census_by_analysis(spark, sf_dir):
    """AGG1, AGG2, JOI1: by analysis id with missing ids as one, and the classes of each."""
    df = idx(spark, sf_dir).withColumn("analysis", C.known_id(F.col("analysis")))
    return C.census(df, ["analysis"]).join(df.groupBy("analysis").agg(C.joined(F.col("class")).alias("classes")), "analysis", "left")


@r.query("census_by_class_collection", _census("class, collection", f"class IN ({sql_list(DERIVED)})"))
def census_by_class_collection(spark, sf_dir):
    return C.census(idx(spark, sf_dir).filter(F.col("class").isin(*DERIVED)), ["class", "collection"])


@r.query("class_list", "SELECT collection, string_agg(DISTINCT class, ' | ' ORDER BY class) AS classes, count(DISTINCT class) AS n_classes FROM idx GROUP BY collection")
def class_list(spark, sf_dir):
    """AGG2."""
    return idx(spark, sf_dir).groupBy("collection").agg(C.joined(F.col("class")).alias("classes"), F.count_distinct("class").alias("n_classes"))


@r.query("share_within", "SELECT class, syntax, count(*) AS series, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY class), 2) AS pct FROM idx GROUP BY class, syntax")
def share_within(spark, sf_dir):
    """AGG3: transfer syntaxes as shares of their class."""
    return C.share_within(idx(spark, sf_dir).groupBy("class", "syntax").agg(F.count("*").alias("series")), "series", ["class"])


@r.query(
    "licences",
    "SELECT class, licence, count(*) AS series, sum(count(*) FILTER (WHERE licence LIKE '%NC%')) OVER (PARTITION BY class)::BIGINT AS non_commercial FROM idx GROUP BY class, licence",
)
def licences(spark, sf_dir):
    """AGG4."""
    by = idx(spark, sf_dir).groupBy("class", "licence").agg(F.count("*").alias("series"))
    nc = F.sum(F.when(F.contains("licence", F.lit("NC")), F.col("series")).otherwise(0)).over(C.Window.partitionBy("class"))
    return by.withColumn("non_commercial", nc)


@r.query(
    "first_file_gap",
    """WITH o AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
       SELECT count(*) AS series, count(*) FILTER (WHERE n > 1) AS multi, sum(n)::BIGINT AS instances, sum(n - 1)::BIGINT AS missed,
         round(100.0 * count(*) FILTER (WHERE n > 1) / count(*), 2) AS pct_multi, round(100.0 * sum(n - 1) / sum(n), 2) AS pct_missed FROM o""",
)
def first_file_gap(spark, sf_dir):
    """AGG5: what looking at one instance per series misses."""
    per = read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    total, multi, missed, all_ = F.count("*"), F.count_if(F.col("n") > 1), F.sum(F.col("n") - 1), F.sum("n")
    return per.agg(total.alias("series"), multi.alias("multi"), all_.alias("instances"), missed.alias("missed"), percent(multi, total).alias("pct_multi"), percent(missed, all_).alias("pct_missed"))


@r.query(
    "attribute_split",
    """SELECT class, syntax, licence, maker IS NULL AS no_maker, analysis IS NULL AS no_analysis, instances > 3 AS many, count(*) AS series, min(uid) AS first_uid,
       count(DISTINCT patient) AS patients, string_agg(DISTINCT collection, ' | ' ORDER BY collection) AS collections FROM idx GROUP BY ALL""",
)
def attribute_split(spark, sf_dir):
    """AGG6: a wide split on six keys."""
    keys = ["class", "syntax", "licence", F.col("maker").isNull().alias("no_maker"), F.col("analysis").isNull().alias("no_analysis"), (F.col("instances") > 3).alias("many")]
    return idx(spark, sf_dir).groupBy(*keys).agg(F.count("*").alias("series"), F.min("uid").alias("first_uid"), F.count_distinct("patient").alias("patients"), C.joined(F.col("collection")).alias("collections"))


@r.query("budget", f"SELECT class, count(*) AS series, round(sum(mb), 2) AS mb FROM idx WHERE class NOT IN ({sql_list(DERIVED)}) GROUP BY class")
def budget(spark, sf_dir):
    """AGG7: rows and bytes of the small classes."""
    return idx(spark, sf_dir).filter(~F.col("class").isin(*DERIVED)).groupBy("class").agg(F.count("*").alias("series"), F.round(F.sum("mb"), 2).alias("mb"))


MELT = "SELECT class, 'maker' AS attribute, maker AS value FROM idx UNION ALL SELECT class, 'model', model FROM idx UNION ALL SELECT class, 'description', description FROM idx"


@r.query(
    "population",
    f"""WITH m AS ({MELT}) SELECT class, attribute, count(*) AS rows, count(*) FILTER (WHERE value IS NULL) AS nulls, count(*) FILTER (WHERE trim(value) = '') AS empties,
        count(*) FILTER (WHERE trim(value) <> '') AS populated, count(DISTINCT value) FILTER (WHERE trim(value) <> '') AS distinct_values,
        round(100.0 * count(*) FILTER (WHERE trim(value) <> '') / count(*), 2) AS pct_populated FROM m GROUP BY class, attribute""",
)
def population(spark, sf_dir):
    """AGG8."""
    return C.population(idx(spark, sf_dir), ["maker", "model", "description"], ["class"])


def classified_sql(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN 'absent' WHEN trim({column}) = '' THEN 'absent' ELSE {case_sql(f'lower(trim({column}))', PRODUCT_RULES, 0, chr(39) + 'unclassified' + chr(39))} END"


def rule_sql(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN 'null' WHEN trim({column}) = '' THEN 'empty string' ELSE {case_sql(f'lower(trim({column}))', PRODUCT_RULES, 1, f'left(trim({column}), 60)')} END"


@r.query("classify", f"SELECT uid, {classified_sql('maker')} AS category, {rule_sql('maker')} AS rule FROM idx")
def classify(spark, sf_dir):
    """CLS1, on distinct values."""
    return R.classify_distinct(idx(spark, sf_dir).select("uid", "maker"), "maker", PRODUCT_RULES).select("uid", "category", "rule")


@r.query(
    "classify_extended",
    f"""WITH b AS (SELECT uid, maker, {classified_sql('maker')} AS c, {rule_sql('maker')} AS l FROM idx)
        SELECT uid, CASE WHEN c = 'unclassified' THEN {case_sql('lower(trim(maker))', EXTRA_RULES, 0, "'unclassified'")} ELSE c END AS category,
          CASE WHEN c = 'unclassified' THEN {case_sql('lower(trim(maker))', EXTRA_RULES, 1, 'l')} ELSE l END AS rule,
          c = 'unclassified' AND {case_sql('lower(trim(maker))', EXTRA_RULES, 0, "'unclassified'")} <> 'unclassified' AS from_extra FROM b""",
)
def classify_extended(spark, sf_dir):
    """CLS2."""
    v = R.classify_extended(F.col("maker"), PRODUCT_RULES, EXTRA_RULES)
    return R.on_distinct(idx(spark, sf_dir).select("uid", "maker"), ["maker"], v, "v").select("uid", "v.category", "v.rule", "v.from_extra")


WRITER_TEXT = "lower(concat(coalesce(maker, ''), ' ', coalesce(model, '')))"
WRITER_SQL = case_sql(WRITER_TEXT, WRITER_RULES, 0, "'not identifiable from index'")


def writer():
    both = F.lower(F.concat_ws(" ", F.coalesce("maker", F.lit("")), F.coalesce("model", F.lit(""))))
    return R.first_match(both, WRITER_RULES, R.decision(F.lit("not identifiable from index"), F.lit(None).cast("string")))["category"]


@r.query("writer_of", f"SELECT uid, {WRITER_SQL} AS writer FROM idx")
def writer_of(spark, sf_dir):
    """CLS3."""
    return R.on_distinct(idx(spark, sf_dir).select("uid", "maker", "model"), ["maker", "model"], writer(), "writer").select("uid", "writer")


@r.query(
    "writer_from_object",
    f"""SELECT uid, coalesce({case_sql("lower(coalesce(description, ''))", WRITER_RULES, 0, 'NULL')}, {case_sql("lower(coalesce(model, ''))", WRITER_RULES, 0, 'NULL')}, {case_sql("lower(coalesce(maker, ''))", WRITER_RULES, 0, 'NULL')}, 'unknown') AS writer,
        CASE WHEN {case_sql("lower(coalesce(description, ''))", WRITER_RULES, 0, 'NULL')} IS NOT NULL THEN 'description' WHEN {case_sql("lower(coalesce(model, ''))", WRITER_RULES, 0, 'NULL')} IS NOT NULL THEN 'model'
             WHEN {case_sql("lower(coalesce(maker, ''))", WRITER_RULES, 0, 'NULL')} IS NOT NULL THEN 'maker' ELSE 'none' END AS carrier FROM idx""",
)
def writer_from_object(spark, sf_dir):
    """CLS4: a cascade of carriers, and which decided."""
    v = R.cascade((F.col("description"), "description"), (F.col("model"), "model"), (F.col("maker"), "maker"), rules=WRITER_RULES, default="unknown")
    return idx(spark, sf_dir).withColumn("v", v).select("uid", F.col("v.category").alias("writer"), "v.carrier")


@r.query(
    "expectation_verdict",
    f"""WITH e(maker_word, expected) AS (VALUES ('bolt', 'bolt works'), ('ring', 'ring makers'), ('gear', 'bolt works'))
        SELECT uid, CASE WHEN e.expected IS NULL THEN 'no expectation' WHEN {WRITER_SQL} = 'not identifiable from index' THEN 'silent' WHEN e.expected = {WRITER_SQL} THEN 'agree' ELSE 'disagree' END AS verdict
        FROM idx LEFT JOIN e ON e.maker_word = split_part(maker, ' ', 2)""",
)
def expectation_verdict(spark, sf_dir):
    """CLS6."""
    expected = F.create_map(*[F.lit(x) for kv in {"bolt": "bolt works", "ring": "ring makers", "gear": "bolt works"}.items() for x in kv])
    df = idx(spark, sf_dir).withColumn("w", writer())
    return df.select("uid", R.expectation(F.element_at(expected, F.split_part(F.col("maker"), F.lit(" "), F.lit(2))), F.col("w"), "not identifiable from index").alias("verdict"))


BUCKET_SQL = """CASE WHEN coalesce(trim(maker), '') = '' AND coalesce(trim(model), '') = '' THEN 'absent'
  WHEN coalesce(trim(maker), '') = '' THEN 'encoder_only' WHEN coalesce(trim(model), '') = '' THEN 'other' ELSE 'producer_and_converter' END"""


def bucket():
    no = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return F.when(no("maker") & no("model"), "absent").when(no("maker"), "encoder_only").when(no("model"), "other").otherwise("producer_and_converter")


@r.query("bucket_of", f"SELECT uid, {BUCKET_SQL} AS bucket FROM idx")
def bucket_of(spark, sf_dir):
    """CLS7."""
    return idx(spark, sf_dir).select("uid", bucket().alias("bucket"))


@r.query(
    "buckets",
    f"""WITH b AS (SELECT {BUCKET_SQL} AS bucket, model FROM idx) SELECT bucket, list_position([{sql_list(BUCKETS)}], bucket)::INTEGER AS position, count(*) AS series, count(DISTINCT model) AS models,
        round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM b GROUP BY bucket""",
)
def buckets(spark, sf_dir):
    """AGG12: shares in the fixed order."""
    per = idx(spark, sf_dir).groupBy(bucket().alias("bucket")).agg(F.count("*").alias("series"), F.count_distinct("model").alias("models"))
    whole = per.agg(F.sum("series").alias("whole"))
    position = F.array_position(F.array(*[F.lit(b) for b in BUCKETS]), F.col("bucket")).cast("int")
    return per.join(whole).select("bucket", position.alias("position"), "series", "models", percent(F.col("series"), F.col("whole")).alias("pct"))


CONVENTION_SQL = f"""CASE WHEN regexp_matches(lower(coalesce(maker, '')), 'bolt|gear') AND regexp_matches(lower(coalesce(model, '')), 'brand#1') THEN 'pair rule'
   WHEN syntax = 'P' THEN 'inherited'
   WHEN coalesce(trim(model), '') = '' AND len(list_intersect(list_filter(regexp_split_to_array(lower(maker), '[^a-z0-9]+'), lambda t: length(t) > 2 AND t NOT IN ({sql_list(CONVENTION_STOP)})),
        list_filter(regexp_split_to_array(lower(description), '[^a-z0-9]+'), lambda t: length(t) > 2 AND t NOT IN ({sql_list(CONVENTION_STOP)})))) > 0 THEN 'named in description'
   ELSE 'none' END"""


def convention():
    shared = F.size(F.array_intersect(R.distinctive_tokens(F.col("maker"), CONVENTION_STOP), R.distinctive_tokens(F.col("description"), CONVENTION_STOP))) > 0
    pair = F.lower(F.coalesce("maker", F.lit(""))).rlike("bolt|gear") & F.lower(F.coalesce("model", F.lit(""))).rlike("brand#1")
    return F.when(pair, "pair rule").when(F.col("syntax") == "P", "inherited").when((F.coalesce(F.trim("model"), F.lit("")) == "") & shared, "named in description").otherwise("none")


@r.query("convention_of", f"SELECT uid, {CONVENTION_SQL} AS convention FROM idx")
def convention_of(spark, sf_dir):
    """CLS8, CLS12: pair rules, then the inherited flag, then shared tokens."""
    return idx(spark, sf_dir).select("uid", convention().alias("convention"))


@r.query(
    "conventions",
    f"SELECT {CONVENTION_SQL} AS convention, count(*) AS series, count(DISTINCT analysis) AS analyses, min(concat(coalesce(maker, ''), ' / ', coalesce(model, ''))) AS example FROM idx GROUP BY 1",
)
def conventions(spark, sf_dir):
    """AGG13; the example is the smallest, not the first seen."""
    example = F.concat_ws(" / ", F.coalesce("maker", F.lit("")), F.coalesce("model", F.lit("")))
    return idx(spark, sf_dir).groupBy(convention().alias("convention")).agg(F.count("*").alias("series"), F.count_distinct("analysis").alias("analyses"), F.min(example).alias("example"))


@r.query("is_sentinel", f"SELECT uid, coalesce(lower(trim(maker)) IN ({sql_list(SENTINELS)}), false) AS sentinel FROM idx")
def is_sentinel(spark, sf_dir):
    """CLS9."""
    return idx(spark, sf_dir).select("uid", R.is_sentinel(F.col("maker"), SENTINELS).alias("sentinel"))


INFORMATIVE = f"""list_filter(list_sort(list_distinct(list_filter([maker, model, description], lambda v: v IS NOT NULL))), lambda v: lower(trim(v)) NOT IN ({sql_list(SENTINELS)})
   AND len(list_filter(regexp_split_to_array(v, '[^A-Za-z0-9.]+'), lambda t: length(t) >= 3 AND lower(t) NOT IN ({sql_list(GENERIC)}) AND NOT regexp_matches(t, '^[0-9]+$') AND NOT regexp_matches(lower(t), 'http|github'))) > 0)[1]"""


@r.query("informative", f"SELECT uid, {INFORMATIVE} AS value FROM idx")
def informative(spark, sf_dir):
    """CLS10."""
    return idx(spark, sf_dir).select("uid", R.informative(F.array("maker", "model", "description"), GENERIC, SENTINELS).alias("value"))


VERSIONED = f"list_filter([model, description], lambda v: v IS NOT NULL AND lower(trim(v)) NOT IN ({sql_list(SENTINELS)}) AND NOT regexp_matches(v, 'Brand#2') AND regexp_matches(v, '{VERSION}'))[1]"


@r.query("has_version", f"SELECT uid, {VERSIONED} IS NOT NULL AS has_version, regexp_extract({VERSIONED}, '({VERSION})', 1) AS token, {VERSIONED} AS source FROM idx")
def has_version(spark, sf_dir):
    """CLS11."""
    v = R.version_of(F.array("model", "description"), VERSION, ["Brand#2"], SENTINELS)
    return idx(spark, sf_dir).withColumn("v", v).select("uid", "v.has_version", "v.token", "v.source")


@r.query("distinctive_tokens", f"SELECT uid, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(description), '[^a-z0-9]+'), lambda t: length(t) > 2 AND t NOT IN ({sql_list(CONVENTION_STOP)})))), ' ') AS tokens FROM idx")
def distinctive_tokens(spark, sf_dir):
    """CLS12."""
    return idx(spark, sf_dir).select("uid", F.array_join(F.array_sort(R.distinctive_tokens(F.col("description"), CONVENTION_STOP)), " ").alias("tokens"))


@r.query("three_state", "SELECT uid, CASE WHEN maker IS NULL THEN 'absent' WHEN trim(maker) = '' THEN 'empty' ELSE 'non_empty' END AS maker_state, CASE WHEN model IS NULL THEN 'absent' WHEN trim(model) = '' THEN 'empty' ELSE 'non_empty' END AS model_state FROM idx")
def three_state(spark, sf_dir):
    """CLS13."""
    return idx(spark, sf_dir).select("uid", R.three_state(F.col("maker")).alias("maker_state"), R.three_state(F.col("model")).alias("model_state"))


JSON = "concat('{', CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN '\"a\": null' WHEN 2 THEN '\"a\": \"\"' ELSE '\"a\": \"x\"' END, '}')"


@r.query("three_state_json", "SELECT o_orderkey AS uid, CASE o_orderkey % 4 WHEN 0 THEN 'absent' WHEN 1 THEN 'empty' WHEN 2 THEN 'empty' ELSE 'non_empty' END AS state FROM orders")
def three_state_json(spark, sf_dir):
    """CLS13 on raw JSON: a missing member stays apart from a null."""
    return read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("uid"), R.json_state(F.expr(JSON), "$.a").alias("state"))


@r.query("normalise_spelling", "SELECT DISTINCT url, regexp_replace(replace(regexp_replace(lower(trim(url)), '^[a-z]+://', ''), ':', '/'), '\\.git$', '') AS spelling FROM pages")
def normalise_spelling(spark, sf_dir):
    """CLS15."""
    return read_table(spark, sf_dir, "pages").select("url", X.normalise_spelling(F.col("url")).alias("spelling")).distinct()


@r.query("clip", "SELECT page_id, CASE WHEN length(url) > 24 THEN concat(rtrim(left(url, 24)), ' ...') ELSE url END AS clipped FROM pages")
def clip(spark, sf_dir):
    """CLS26."""
    return read_table(spark, sf_dir, "pages").select("page_id", X.clip(F.col("url"), 24).alias("clipped"))


@r.query(
    "strip_markup",
    "SELECT page_id, trim(regexp_replace(regexp_replace(translate(regexp_replace(html, '<[^>]*>', ' ', 'g'), '‐‑‒–—', '-----'), '[ \\t\\r\\n]+', ' ', 'g'), ' ([:;,.])', '\\1', 'g')) AS plain FROM pages",
)
def strip_markup(spark, sf_dir):
    """CLS27."""
    return read_table(spark, sf_dir, "pages").select("page_id", X.strip_markup(F.col("html")).alias("plain"))


@r.query(
    "search_record_classify",
    """WITH u AS (SELECT page_id, url, html, regexp_extract(url, '[?&](q|query|term)=([^&#]*)', 2) AS q FROM pages)
       SELECT page_id, CASE WHEN contains(lower(url), 'example.com') THEN 'com index' WHEN contains(lower(url), 'example.net') THEN 'net index' WHEN contains(lower(url), 'example') THEN 'other index' ELSE 'unknown' END AS source,
       CASE WHEN contains(url, '://m.') THEN 'mobile' WHEN contains(url, '?') THEN 'web query' ELSE 'web' END AS interface,
       coalesce(nullif(regexp_extract(url, '[?&]page=([0-9]+)', 1), ''), 'not captured') AS page,
       coalesce(nullif(url_decode(replace(q, '+', ' ')), ''), nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), ''), 'not captured') AS query,
       coalesce(nullif(replace(regexp_extract(html, '([0-9][0-9,]*) (results|hits|records)', 1), ',', ''), ''), 'not captured') AS hits FROM u""",
)
def search_record_classify(spark, sf_dir):
    """CLS28: source, interface, the decoded query (of the URL, else the page's title) and the stated number of hits."""
    url = F.col("url")
    source = R.first_match(F.lower(url), [("com index", "", r"example\.com"), ("net index", "", r"example\.net"), ("other index", "", "example")], R.decision(F.lit("unknown"), F.lit("")))["category"]
    how = F.when(F.contains(url, F.lit("://m.")), "mobile").when(F.contains(url, F.lit("?")), "web query").otherwise("web")
    return read_table(spark, sf_dir, "pages").select("page_id", source.alias("source"), how.alias("interface"), *[v.alias(c) for c, v in C.search_fields(url, F.col("html")).items()])


@r.query(
    "value_distribution",
    f"SELECT CASE WHEN maker IS NULL THEN '(null)' WHEN trim(maker) = '' THEN '(empty)' ELSE maker END AS value, any_value({classified_sql('maker')}) AS category, count(*) AS series, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM idx GROUP BY 1",
)
def value_distribution(spark, sf_dir):
    """AGG9: the rules run on the grouped values."""
    shown = F.when(F.col("maker").isNull(), "(null)").when(F.trim("maker") == "", "(empty)").otherwise(F.col("maker"))
    per = idx(spark, sf_dir).groupBy(shown.alias("value")).agg(F.count("*").alias("series"), F.min("maker").alias("_raw"))
    whole = per.agg(F.sum("series").alias("whole"))
    return per.join(whole).select("value", R.classify(F.col("_raw"), PRODUCT_RULES)["category"].alias("category"), "series", percent(F.col("series"), F.col("whole")).alias("pct"))


@r.query(
    "category_counts",
    f"WITH m AS ({MELT}), c AS (SELECT attribute, value, {classified_sql('value')} AS category FROM m) SELECT attribute, category, count(*) AS series, count(DISTINCT value) AS distinct_values, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY attribute), 2) AS pct FROM c GROUP BY attribute, category",
)
def category_counts(spark, sf_dir):
    """AGG10."""
    values = C.melt(idx(spark, sf_dir), [], ["maker", "model", "description"]).groupBy("attribute", "value").agg(F.count("*").alias("n"))
    per = values.withColumn("category", R.classify(F.col("value"), PRODUCT_RULES)["category"]).groupBy("attribute", "category").agg(F.sum("n").alias("series"), F.count("value").alias("distinct_values"))
    return C.share_within(per, "series", ["attribute"])


@r.query(
    "spelling_variants",
    f"""WITH v AS (SELECT {rule_sql('maker')} AS rule, maker, count(*) AS series FROM idx WHERE trim(maker) <> '' GROUP BY ALL)
        SELECT *, row_number() OVER (PARTITION BY rule ORDER BY series DESC, maker) AS place, count(*) OVER (PARTITION BY rule) AS spellings FROM v""",
)
def spelling_variants(spark, sf_dir):
    """AGG11: a row for each spelling."""
    return C.spellings(idx(spark, sf_dir).filter(F.trim("maker") != ""), "maker", R.classify(F.col("maker"), PRODUCT_RULES)["rule"])


@r.query("pair_counts", f"SELECT maker, model, count(*) AS series FROM idx WHERE {BUCKET_SQL} = 'other' GROUP BY maker, model")
def pair_counts(spark, sf_dir):
    """AGG14."""
    return idx(spark, sf_dir).filter(bucket() == "other").groupBy("maker", "model").agg(F.count("*").alias("series"))


@r.query(
    "name_agreement",
    f"""WITH d AS (SELECT collection, maker, len(list_intersect(list_filter(regexp_split_to_array(lower(maker), '[^a-z0-9]+'), lambda t: length(t) > 2 AND t NOT IN ({sql_list(CONVENTION_STOP)})), list_filter(regexp_split_to_array(lower(description), '[^a-z0-9]+'), lambda t: length(t) > 2 AND t NOT IN ({sql_list(CONVENTION_STOP)})))) > 0 AS hit FROM idx),
        v AS (SELECT collection, maker, count(*) AS n FROM d WHERE maker IS NOT NULL GROUP BY collection, maker QUALIFY row_number() OVER (PARTITION BY collection ORDER BY n DESC, maker) <= 2),
        t AS (SELECT collection, string_agg(concat(maker, ' (', n, ')'), '; ' ORDER BY n DESC, maker) AS top_values FROM v GROUP BY collection)
        SELECT d.collection, count(*) AS series, count(*) FILTER (WHERE hit) AS hits, round(100.0 * count(*) FILTER (WHERE hit) / count(*), 2) AS pct, any_value(top_values) AS top_values FROM d LEFT JOIN t USING (collection) GROUP BY d.collection""",
)
def name_agreement(spark, sf_dir):
    """AGG15."""
    df = idx(spark, sf_dir)
    hit = F.size(F.array_intersect(R.distinctive_tokens(F.col("maker"), CONVENTION_STOP), R.distinctive_tokens(F.col("description"), CONVENTION_STOP))) > 0
    rate = df.groupBy("collection").agg(F.count("*").alias("series"), F.count_if(hit).alias("hits"), percent(F.count_if(hit), F.count("*")).alias("pct"))
    counts = df.filter("maker IS NOT NULL").groupBy("collection", "maker").agg(F.count("*").alias("n"))
    two = C.top(counts, ["collection"], [F.desc("n"), F.asc("maker")], 2)
    text = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "maker"))), lambda s: F.concat(s.maker, F.lit(" ("), (-s.m).cast("string"), F.lit(")")))
    return rate.join(two.groupBy("collection").agg(F.array_join(text, "; ").alias("top_values")), "collection", "left")


@r.query("writer_census", f"SELECT {WRITER_SQL} AS writer, count(*) AS series, sum(instances)::BIGINT AS instances, count(DISTINCT collection) AS collections, count(DISTINCT analysis) AS analyses, count(DISTINCT class) AS classes FROM idx GROUP BY 1")
def writer_census(spark, sf_dir):
    """AGG16."""
    return idx(spark, sf_dir).groupBy(writer().alias("writer")).agg(F.count("*").alias("series"), F.sum("instances").alias("instances"), *[F.count_distinct(c).alias(n) for c, n in (("collection", "collections"), ("analysis", "analyses"), ("class", "classes"))])


@r.query(
    "cohort_recall",
    """WITH s AS (SELECT url, regexp_replace(replace(regexp_replace(lower(trim(url)), '^[a-z]+://', ''), ':', '/'), '\\.git$', '') AS spelling, count(*) AS n FROM pages WHERE contains(lower(url), 'example') GROUP BY url),
       t AS (SELECT url, n FROM s ORDER BY n DESC, url LIMIT 1)
       SELECT sum(s.n)::BIGINT AS total, count(*) AS spellings, any_value(t.url) AS top_spelling, any_value(t.n) AS exact_hits, (sum(s.n) - any_value(t.n))::BIGINT AS missed, count(DISTINCT spelling) AS groups FROM s, t""",
)
def cohort_recall(spark, sf_dir):
    """AGG17: what an exact query for the commonest spelling finds of all."""
    per = read_table(spark, sf_dir, "pages").filter(F.contains(F.lower("url"), F.lit("example"))).groupBy("url").agg(F.count("*").alias("n"))
    best = F.min_by("url", F.struct((-F.col("n")).alias("m"), "url"))
    return per.agg(F.sum("n").alias("total"), F.count("*").alias("spellings"), best.alias("top_spelling"), F.max("n").alias("exact_hits"), F.count_distinct(X.normalise_spelling(F.col("url"))).alias("groups")).withColumn("missed", F.col("total") - F.col("exact_hits"))


VERSION_TEXT = "[A-Za-z]+ [0-9]+"


@r.query(
    "carrier_hierarchy",
    f"""WITH d AS (SELECT analysis, 1 AS level, maker AS value FROM idx WHERE analysis IS NOT NULL UNION ALL SELECT analysis, 2, model FROM idx WHERE analysis IS NOT NULL UNION ALL SELECT analysis, 3, description FROM idx WHERE analysis IS NOT NULL),
        v AS (SELECT DISTINCT analysis, level, value FROM d WHERE value IS NOT NULL),
        g AS (SELECT analysis, level, min(value) AS example FROM v WHERE lower(trim(value)) NOT IN ({sql_list(SENTINELS)}) AND len(list_filter(regexp_split_to_array(value, '[^A-Za-z0-9.]+'), lambda t: length(t) >= 3 AND lower(t) NOT IN ({sql_list(GENERIC)}) AND NOT regexp_matches(t, '^[0-9]+$') AND NOT regexp_matches(lower(t), 'http|github'))) > 0 GROUP BY ALL),
        n AS (SELECT analysis, count(*) AS series FROM idx WHERE analysis IS NOT NULL GROUP BY analysis HAVING count(*) >= 10),
        f AS (SELECT analysis, value, row_number() OVER (PARTITION BY analysis ORDER BY value) AS k FROM v WHERE level = 3),
        x AS (SELECT analysis, min(nullif(regexp_extract(value, '{VERSION_TEXT}'), '')) AS version_example FROM f GROUP BY analysis)
        SELECT n.analysis, any_value(series) AS series, max(example) FILTER (WHERE level = 1) AS level1, max(example) FILTER (WHERE level = 2) AS level2, max(example) FILTER (WHERE level = 3) AS level3, min(level)::INTEGER AS level, arg_min(example, level) AS example, any_value(version_example) IS NOT NULL AS version_in_text, any_value(version_example) AS version_example
        FROM n LEFT JOIN g USING (analysis) LEFT JOIN x USING (analysis) GROUP BY n.analysis""",
)
def carrier_hierarchy(spark, sf_dir):
    """AGG18: each level's telling value, the first level with one, and whether the descriptions name a version."""
    df = idx(spark, sf_dir).filter("analysis IS NOT NULL")
    return C.carrier_hierarchy(df, "analysis", ["maker", "model", "description"], lambda c: R.informative(F.array(c), GENERIC, SENTINELS), "description", VERSION_TEXT, 10)


@r.query(
    "both_ways",
    """WITH u AS (SELECT doi, count(*) AS n, count(*) FILTER (WHERE coalesce(trim(maker), '') = '') AS k FROM idx GROUP BY doi)
       SELECT sum(n)::BIGINT AS objects, sum(k)::BIGINT AS flagged, count(*) AS units, count(*) FILTER (WHERE k = 0) AS units_none, count(*) FILTER (WHERE k = n) AS units_all,
              count(*) FILTER (WHERE k > 0 AND k < n) AS units_between, coalesce(sum(n) FILTER (WHERE k > 0 AND k < n), 0)::BIGINT AS objects_between FROM u""",
)
def both_ways(spark, sf_dir):
    """AGG26."""
    return C.both_ways(idx(spark, sf_dir), "doi", F.coalesce(F.trim("maker"), F.lit("")) == "")


@r.query("source_doi", "SELECT collection, doi, count(DISTINCT uid) AS series FROM (SELECT * REPLACE (CASE WHEN uid % 9 = 0 THEN NULL ELSE doi END AS doi) FROM idx) GROUP BY ALL")
def source_doi(spark, sf_dir):
    """AGG43: a missing DOI is a group of its own."""
    return idx(spark, sf_dir).withColumn("doi", F.when(F.col("uid") % 9 != 0, F.col("doi"))).groupBy("collection", "doi").agg(F.count_distinct("uid").alias("series"))


@r.query("bounded_objects", "SELECT kind, count(*) AS objects, count(DISTINCT uid) AS series FROM seg GROUP BY kind")
def bounded_objects(spark, sf_dir):
    """AGG46."""
    return view(spark, sf_dir, "seg").groupBy("kind").agg(F.count("*").alias("objects"), F.count_distinct("uid").alias("series"))


@r.query(
    "writer_versions",
    "SELECT model, CASE WHEN maker IS NULL THEN 'absent' WHEN trim(maker) = '' THEN 'empty' ELSE 'non_empty' END AS maker_state, count(*) AS series FROM idx WHERE starts_with(model, 'Brand#1') GROUP BY ALL",
)
def writer_versions(spark, sf_dir):
    """AGG45."""
    return idx(spark, sf_dir).filter(F.startswith("model", F.lit("Brand#1"))).groupBy("model", R.three_state(F.col("maker")).alias("maker_state")).agg(F.count("*").alias("series"))


@r.query("version_carriers", "SELECT model, class, coalesce(analysis, '(null)') AS analysis, count(*) AS series FROM idx WHERE regexp_matches(model, 'v[0-9]+\\.[01]$') GROUP BY ALL")
def version_carriers(spark, sf_dir):
    """AGG30."""
    return idx(spark, sf_dir).filter(F.col("model").rlike(r"v[0-9]+\.[01]$")).groupBy("model", "class", C.known_id(F.col("analysis")).alias("analysis")).agg(F.count("*").alias("series"))


@r.query(
    "repo_class",
    """SELECT uid, CASE WHEN NOT regexp_matches(h, '^[0-9a-f]{7}$') THEN 'not a repo' WHEN syntax = 'F' THEN 'upstream' WHEN regexp_matches(coalesce(description, ''), 'bolt|gear') THEN concat('fork ', regexp_extract(description, '(bolt|gear)', 1)) ELSE 'orphan' END AS repo
       FROM (SELECT *, CASE WHEN uid % 3 = 0 THEN model ELSE left(sha256(CAST(uid AS VARCHAR)), 7) END AS h FROM idx) WHERE h IS NOT NULL""",
)
def repo_class(spark, sf_dir):
    """CLS23."""
    df = idx(spark, sf_dir).withColumn("h", F.when(F.col("uid") % 3 == 0, F.col("model")).otherwise(F.substring(F.sha2(F.col("uid").cast("string"), 256), 1, 7))).filter("h IS NOT NULL")
    known = F.coalesce("description", F.lit("")).rlike("bolt|gear")
    kind = F.when(~F.col("h").rlike("^[0-9a-f]{7}$"), "not a repo").when(F.col("syntax") == "F", "upstream").when(known, F.concat(F.lit("fork "), F.regexp_extract("description", "(bolt|gear)", 1))).otherwise("orphan")
    return df.select("uid", kind.alias("repo"))


@r.query("names_producer", f"SELECT uid, list_filter(list_sort(list_distinct(list_filter([maker, description], lambda v: v IS NOT NULL))), lambda v: trim(v) <> '' AND {case_sql('lower(trim(v))', PRODUCT_RULES, 0, chr(39) + 'unclassified' + chr(39))} = 'named')[1] AS producer FROM idx")
def names_producer(spark, sf_dir):
    """CLS25."""
    return idx(spark, sf_dir).select("uid", R.names_producer(F.array("maker", "description"), PRODUCT_RULES, "named").alias("producer"))


GRADE_SQL = f"""CASE WHEN maker IS NULL OR trim(maker) = '' THEN 'non-conformant' WHEN {classified_sql('maker')} = 'named' OR {classified_sql('model')} = 'named' OR {classified_sql('description')} = 'named' THEN 'informative' ELSE 'uninformative' END"""


def grade():
    named = lambda c: R.classify(F.col(c), PRODUCT_RULES)["category"] == "named"
    return F.when(R.three_state(F.col("maker")) != "non_empty", "non-conformant").when(named("maker") | named("model") | named("description"), "informative").otherwise("uninformative")


@r.query("grade", f"SELECT uid, {GRADE_SQL} AS grade, CASE WHEN maker IS NULL THEN 'absent' WHEN trim(maker) = '' THEN 'empty' ELSE {classified_sql('maker')} END AS reason FROM idx")
def grade_query(spark, sf_dir):
    """CLS24."""
    reason = F.when(F.col("maker").isNull(), "absent").when(F.trim("maker") == "", "empty").otherwise(R.classify(F.col("maker"), PRODUCT_RULES)["category"])
    return idx(spark, sf_dir).select("uid", grade().alias("grade"), reason.alias("reason"))


@r.query(
    "grade_table",
    f"""WITH g AS (SELECT class, {KNOWN} AS analysis, {GRADE_SQL} AS grade FROM idx),
        t AS (SELECT CASE WHEN grouping(analysis) = 1 THEN '(all)' ELSE analysis END AS analysis, class, count(*) AS objects, count(*) FILTER (WHERE grade = 'non-conformant') AS nonconformant, count(*) FILTER (WHERE grade = 'uninformative') AS uninformative,
              count(*) FILTER (WHERE grade = 'informative') AS informative FROM g GROUP BY GROUPING SETS ((class), (class, analysis)))
        SELECT *, round(100.0 * informative / objects, 2) AS pct_informative, round(round(100.0 * informative / objects, 2) + round(100.0 * uninformative / objects, 2) + round(100.0 * nonconformant / objects, 2), 2) AS sum_pct FROM t""",
)
def grade_table(spark, sf_dir):
    """AGG31: both groupings in one pass."""
    df = idx(spark, sf_dir).select("class", C.known_id(F.col("analysis")).alias("analysis"), grade().alias("grade"))
    n = lambda g: F.count_if(F.col("grade") == g)
    t = C.grouping(df, ["class", "analysis"], [["class"], ["class", "analysis"]], F.count("*").alias("objects"), n("non-conformant").alias("nonconformant"), n("uninformative").alias("uninformative"), n("informative").alias("informative"))
    p = lambda c: percent(F.col(c), F.col("objects"))
    return t.select("*", p("informative").alias("pct_informative"), F.round(p("informative") + p("uninformative") + p("nonconformant"), 2).alias("sum_pct"))


BUCKET_PCT = ", ".join(f"round(100.0 * count(*) FILTER (WHERE bucket = '{b}') / count(*), 2) AS pct_{b}" for b in BUCKETS)


@r.query(
    "bucket_table",
    f"""WITH b AS (SELECT class, {KNOWN} AS analysis, {BUCKET_SQL} AS bucket FROM idx)
        SELECT class, CASE WHEN grouping(analysis) = 1 THEN '(all)' ELSE analysis END AS analysis, count(*) AS objects, {', '.join(f"count(*) FILTER (WHERE bucket = '{b}') AS {b}" for b in BUCKETS)}, {BUCKET_PCT} FROM b GROUP BY GROUPING SETS ((class), (class, analysis))""",
)
def bucket_table(spark, sf_dir):
    """AGG25: counts and shares of the buckets, per class and per class and analysis."""
    df = idx(spark, sf_dir).select("class", C.known_id(F.col("analysis")).alias("analysis"), bucket().alias("bucket"))
    t = C.grouping(df, ["class", "analysis"], [["class"], ["class", "analysis"]], F.count("*").alias("objects"), *[F.count_if(F.col("bucket") == b).alias(b) for b in BUCKETS])
    return t.select("*", *[percent(F.col(b), F.col("objects")).alias(f"pct_{b}") for b in BUCKETS])


CARRIERS = ["maker", "model", "description"]
STATE_SQL = "CASE WHEN value IS NULL THEN 'absent' WHEN trim(value) = '' THEN 'empty' ELSE 'non_empty' END"


@r.query(
    "carrier_sets",
    f"""WITH m AS (SELECT class, {KNOWN} AS analysis, 'maker' AS carrier, maker AS value FROM idx UNION ALL SELECT class, {KNOWN}, 'model', model FROM idx UNION ALL SELECT class, {KNOWN}, 'description', description FROM idx)
        SELECT class, carrier, CASE WHEN grouping(analysis) = 1 THEN '(all)' ELSE analysis END AS analysis, count(*) FILTER (WHERE {STATE_SQL} = 'absent') AS absent, count(*) FILTER (WHERE {STATE_SQL} = 'empty') AS empty,
          count(*) FILTER (WHERE {STATE_SQL} = 'non_empty') AS non_empty, count(*) FILTER (WHERE carrier = 'maker' AND {STATE_SQL} <> 'non_empty') AS violations
        FROM m GROUP BY GROUPING SETS ((class, carrier), (class, carrier, analysis))""",
)
def carrier_sets(spark, sf_dir):
    """AGG23: three states of each carrier at two groupings; absent and empty stay apart."""
    df = idx(spark, sf_dir).withColumn("analysis", C.known_id(F.col("analysis")))
    m = C.melt(df, ["class", "analysis"], CARRIERS, "carrier").withColumn("state", R.three_state(F.col("value")))
    n = lambda s: F.count_if(F.col("state") == s).alias(s)
    bad = F.count_if((F.col("carrier") == "maker") & (F.col("state") != "non_empty")).alias("violations")
    return C.grouping(m, ["class", "carrier", "analysis"], [["class", "carrier"], ["class", "carrier", "analysis"]], n("absent"), n("empty"), n("non_empty"), bad)


@r.query("flagged_cells", f"SELECT class, {KNOWN} AS analysis, count(*) FILTER (WHERE maker IS NULL) AS absent, count(*) FILTER (WHERE trim(maker) = '') AS empty FROM idx GROUP BY ALL HAVING count(*) FILTER (WHERE coalesce(trim(maker), '') = '') > 0")
def flagged_cells(spark, sf_dir):
    """AGG24."""
    df = idx(spark, sf_dir).groupBy("class", C.known_id(F.col("analysis")).alias("analysis"))
    return df.agg(F.count_if(F.col("maker").isNull()).alias("absent"), F.count_if(F.trim("maker") == "").alias("empty")).filter("absent > 0 OR empty > 0")


@r.query("state_pivot", "SELECT class, 'maker' AS carrier, count(*) FILTER (WHERE maker IS NULL) AS absent, count(*) FILTER (WHERE trim(maker) = '') AS empty, count(*) FILTER (WHERE trim(maker) <> '') AS non_empty FROM idx GROUP BY class UNION ALL SELECT class, 'model', count(*) FILTER (WHERE model IS NULL), count(*) FILTER (WHERE trim(model) = ''), count(*) FILTER (WHERE trim(model) <> '') FROM idx GROUP BY class")
def state_pivot(spark, sf_dir):
    """AGG20: counts by state, pivoted with fixed columns."""
    m = C.melt(idx(spark, sf_dir), ["class"], ["maker", "model"], "carrier")
    return C.states(m, ["class", "carrier"], R.three_state(F.col("value")), ["absent", "empty", "non_empty"])


@r.query("category_table", f"WITH m AS ({MELT}) SELECT class, {classified_sql('value')} AS category, count(*) AS n FROM m GROUP BY ALL")
def category_table(spark, sf_dir):
    """AGG32."""
    m = C.melt(idx(spark, sf_dir), ["class"], ["maker", "model", "description"]).groupBy("class", "value").agg(F.count("*").alias("n"))
    return m.groupBy("class", R.classify(F.col("value"), PRODUCT_RULES)["category"].alias("category")).agg(F.sum("n").alias("n"))


@r.query("unclassified", f"WITH m AS ({MELT}) SELECT value, count(*) AS n FROM m WHERE {classified_sql('value')} = 'unclassified' GROUP BY value")
def unclassified(spark, sf_dir):
    """AGG32: the values that no rule covers, verbatim."""
    m = C.melt(idx(spark, sf_dir), [], ["maker", "model", "description"]).groupBy("value").agg(F.count("*").alias("n"))
    return m.filter(R.classify(F.col("value"), PRODUCT_RULES)["category"] == "unclassified")


@r.query(
    "identity_spread",
    f"SELECT model, count(DISTINCT {WRITER_SQL}) AS writers, count(*) AS series FROM idx WHERE model IS NOT NULL GROUP BY model HAVING count(DISTINCT {WRITER_SQL}) > 1",
)
def identity_spread(spark, sf_dir):
    """AGG39."""
    return idx(spark, sf_dir).filter("model IS NOT NULL").groupBy("model").agg(F.count_distinct(writer()).alias("writers"), F.count("*").alias("series")).filter("writers > 1")


@r.query(
    "writer_table1",
    f"""WITH w AS (SELECT class, {WRITER_SQL} AS writer, CASE WHEN description IS NULL THEN 'index' ELSE 'object' END AS evidence FROM idx)
        SELECT class, writer, evidence, count(*) AS series, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY class), 2) AS pct FROM w GROUP BY class, writer, evidence""",
)
def writer_table1(spark, sf_dir):
    """AGG40."""
    per = idx(spark, sf_dir).groupBy("class", writer().alias("writer"), F.when(F.col("description").isNull(), "index").otherwise("object").alias("evidence")).agg(F.count("*").alias("series"))
    return C.share_within(per, "series", ["class"])


@r.query("totals", "SELECT count(*) AS series, sum(instances)::BIGINT AS instances, round(sum(mb), 2) AS mb, count(DISTINCT collection) AS collections, count(DISTINCT analysis) AS analyses, count(*) FILTER (WHERE analysis IS NULL) AS unattributed FROM idx")
def totals(spark, sf_dir):
    """AGG38."""
    return C.totals(idx(spark, sf_dir))


INHERIT = """WITH a AS (SELECT DISTINCT {key}trim(maker) AS maker, trim(model) AS model FROM idx WHERE class = '5-LOW' AND trim(maker) <> '' AND trim(model) <> ''),
       d AS (SELECT class, collection, coalesce(trim(maker), '') AS maker, coalesce(trim(model), '') AS model FROM idx WHERE class <> '5-LOW'),
       n AS (SELECT d.class, count(*) AS series, count(*) FILTER (WHERE d.maker <> '' AND d.model <> '') AS eligible, count(a.maker) AS inherited FROM d LEFT JOIN a USING ({using}) GROUP BY d.class)
       SELECT *, CASE WHEN eligible = 0 THEN 0 ELSE round(100.0 * inherited / eligible, 2) END::DOUBLE AS pct_of_eligible FROM n"""


def inherited(spark, sf_dir, same: bool):
    df = idx(spark, sf_dir)
    return C.inherited(df.filter("class <> '5-LOW'"), df.filter("class = '5-LOW'"), ["class"], ["maker", "model"], ["collection"] if same else [])


@r.query("inherit_same", INHERIT.format(key="collection, ", using="collection, maker, model"))
def inherit_same(spark, sf_dir):
    """JOI2: does the declared pair occur among acquired rows of the same collection; blanks never match."""
    return inherited(spark, sf_dir, True)


@r.query("inherit_any", INHERIT.format(key="", using="maker, model"))
def inherit_any(spark, sf_dir):
    """JOI3: does it occur among acquired rows anywhere."""
    return inherited(spark, sf_dir, False)


@r.query("registry_lookup", "WITH o AS (SELECT collection, arg_min(licence, uid) AS licence, min(uid) AS uid FROM idx GROUP BY collection) SELECT i.class, o.licence, count(*) AS series FROM idx i LEFT JOIN o USING (collection) GROUP BY ALL")
def registry_lookup(spark, sf_dir):
    """JOI4: one row of metadata for each id, the one of the smallest key."""
    df = idx(spark, sf_dir)
    one = df.groupBy("collection").agg(F.min_by("licence", "uid").alias("licence"))
    return df.select("collection", "class").join(one, "collection", "left").groupBy("class", "licence").agg(F.count("*").alias("series"))


OBJECT_CARRIERS = ["description", "model", "maker"]
NOW_SQL = "CASE " + " ".join(f"WHEN {case_sql(f'lower(coalesce({c}, {chr(39) * 2}))', WRITER_RULES, 0, 'NULL')} IS NOT NULL THEN {{{c}}}" for c in OBJECT_CARRIERS) + " ELSE {none} END"
NOW_LABEL = NOW_SQL.format(none="'not identifiable from index'", **{c: case_sql(f"lower(coalesce({c}, ''))", WRITER_RULES, 0, "NULL") for c in OBJECT_CARRIERS})
NOW_CARRIER = NOW_SQL.format(none="'none of the carriers'", **{c: f"'{c}'" for c in OBJECT_CARRIERS})


@r.query(
    "index_vs_object",
    f"""WITH w AS (SELECT class, {WRITER_SQL} AS was, {NOW_LABEL} AS now, {NOW_CARRIER} AS carrier FROM idx)
        SELECT class, was, now, carrier, count(*) AS series, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY class), 2) AS pct, was <> now AS changed FROM w GROUP BY class, was, now, carrier""",
)
def index_vs_object(spark, sf_dir):
    """JOI6: the writer by the index against the writer by the object's own carriers, and the carrier that decided."""
    label, carrier = C.first_carrier({c: R.first_match(F.lower(F.coalesce(c, F.lit(""))), WRITER_RULES, R.decision(F.lit(None).cast("string"), F.lit("")))["category"] for c in OBJECT_CARRIERS}, "not identifiable from index", "none of the carriers")
    per = idx(spark, sf_dir).groupBy("class", writer().alias("was"), label.alias("now"), carrier.alias("carrier")).agg(F.count("*").alias("series"))
    return C.share_within(per, "series", ["class"]).withColumn("changed", F.col("was") != F.col("now"))
