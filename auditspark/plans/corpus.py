"""Document checks: absences, numbers, citations, masks, pairs, search records."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditspark.functions import text as X
from auditspark.operators import prose as D
from auditspark.plans.views import Registry, view
from auditspark.session import read_table

r = Registry()
QUERIES, ORACLES = r.queries, r.oracles


def docs(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")


def notes(spark, sf_dir):
    """Prose over the given rows: a paragraph about each part, with numbers, pairs, ids and citations."""
    p = read_table(spark, sf_dir, "part")
    text = F.concat(
        F.lit("No "), "p_name", F.lit(" was seen in C-"), (F.col("p_partkey") % 900).cast("string"), F.lit(". It weighs "), F.format_number(F.col("p_partkey") * 37 + 1000, 0), F.lit(" g [") , (F.col("p_size") % 9 + 1).cast("string"), F.lit(", "), (F.col("p_size") % 5 + 12).cast("string"),
        F.lit("].\n\nOf these "), F.col("p_size").cast("string"), F.lit(" of "), (F.col("p_size") + F.col("p_partkey") % 3).cast("string"), F.lit(" are "), "p_type", F.lit(", "), (F.col("p_size") * 1.5).cast("string"), F.lit(" percent. None the less it never failed for "), "p_brand", F.lit("."),
    )
    return p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("author"), text.alias("text"))


NOTES = """nt AS (SELECT p_partkey AS id, p_brand AS author, concat('No ', p_name, ' was seen in C-', p_partkey % 900, '. It weighs ', format('{:,}', p_partkey * 37 + 1000), ' g [', p_size % 9 + 1, ', ', p_size % 5 + 12, '].', chr(10), chr(10), 'Of these ', p_size, ' of ', p_size + p_partkey % 3, ' are ', p_type, ', ', CAST(p_size * 1.5 AS DOUBLE), ' percent. None the less it never failed for ', p_brand, '.') AS text FROM part)"""
SENT = NOTES + """, r1 AS (SELECT id, list_filter(regexp_extract_all(text, '[^.!?\\n]+[.!?]?'), lambda s: trim(s) <> '') AS ss FROM nt), sn AS (SELECT id, generate_subscripts(ss, 1) - 1 AS n, trim(unnest(ss)) AS sentence FROM r1)"""


@r.query("sentences", f"WITH {SENT} SELECT id, n::INTEGER AS n, sentence FROM sn")
def sentences(spark, sf_dir):
    """DOC1's sentences."""
    return D.sentences(notes(spark, sf_dir), "id", "text")


@r.query(
    "absence_sweep",
    f"""WITH {SENT}, i AS (SELECT *, list_distinct(regexp_extract_all(sentence, 'C-[0-9]+')) AS ids FROM sn), a AS (SELECT *, list_distinct(list_concat(coalesce(lag(ids) OVER w, []), coalesce(lead(ids) OVER w, []))) AS around FROM i WINDOW w AS (PARTITION BY id ORDER BY n)),
        t AS (SELECT * FROM a WHERE (contains(lower(sentence), 'no ') OR contains(lower(sentence), 'never') OR contains(lower(sentence), 'none')) AND NOT contains(lower(sentence), 'none the less')),
        ev AS (SELECT id AS cid FROM claim WHERE status IN ('MEASURED', 'VERIFIED'))
        SELECT CASE WHEN regexp_matches(lower(sentence), 'seen|weighs') THEN 'data' ELSE 'procedure' END AS kind, CASE WHEN len(list_filter(ids, lambda x: x IN (SELECT cid FROM ev))) > 0 THEN 'backed' WHEN len(list_filter(around, lambda x: x IN (SELECT cid FROM ev))) > 0 THEN 'adjacent' ELSE 'unbacked' END AS verdict, count(*) AS n, sum(len(ids))::BIGINT AS ids
        FROM t GROUP BY 1, 2""".replace("len(list_filter(ids, lambda x: x IN (SELECT cid FROM ev))) > 0", "list_has_any(ids, (SELECT list(cid) FROM ev))").replace("len(list_filter(around, lambda x: x IN (SELECT cid FROM ev))) > 0", "list_has_any(around, (SELECT list(cid) FROM ev))"),
)
def absence_sweep(spark, sf_dir):
    """DOC1."""
    evidence = view(spark, sf_dir, "claim").filter("status IN ('MEASURED', 'VERIFIED')").select("id").distinct()
    s = D.sweep(notes(spark, sf_dir).withColumnRenamed("id", "note"), "note", "text", ["no ", "never", "none"], ["none the less"], "seen|weighs", evidence, "C-[0-9]+")
    return s.groupBy("kind", "verdict").agg(F.count("*").alias("n"), F.sum("n_ids").alias("ids"))


@r.query(
    "numbers_backed",
    f"""WITH {NOTES}, nb AS (SELECT DISTINCT id, unnest(regexp_extract_all(text, '\\b[0-9]{{1,3}}(,[0-9]{{3}})+\\b|\\b[0-9]+(\\.[0-9]+)? (percent|GB|MB)')) AS number FROM nt), ev AS (SELECT DISTINCT format('{{:,}}', p_partkey * 37 + 1000) AS number FROM part WHERE p_partkey % 2 = 0)
        SELECT id, number FROM nb WHERE number NOT IN (SELECT number FROM ev)""",
)
def numbers_backed(spark, sf_dir):
    """DOC2: numbers without evidence."""
    evidence = read_table(spark, sf_dir, "part").filter("p_partkey % 2 = 0").select(F.format_number(F.col("p_partkey") * 37 + 1000, 0).alias("number"))
    return D.unbacked(D.numbers(notes(spark, sf_dir), "id", "text"), evidence, "number").select("id", "number")


CITE = NOTES + """, ct AS (SELECT id, author, unnest(list_transform(flatten(list_transform(regexp_extract_all(text, '\\[([0-9]+(?:, ?[0-9]+)*)\\]', 1), lambda g: string_split_regex(g, ', ?'))), lambda x: CAST(x AS INTEGER))) AS number, generate_subscripts(flatten(list_transform(regexp_extract_all(text, '\\[([0-9]+(?:, ?[0-9]+)*)\\]', 1), lambda g: string_split_regex(g, ', ?'))), 1) - 1 AS place FROM nt)"""


@r.query("citations", f"WITH {CITE} SELECT number, count(DISTINCT id) AS documents, number > 14 AS unresolved FROM ct GROUP BY number")
def citations(spark, sf_dir):
    """DOC3: what is cited where, and what the list of 14 works lacks."""
    c = D.citations(notes(spark, sf_dir), "id", "text")
    return c.groupBy("number").agg(F.count_distinct("id").alias("documents")).withColumn("unresolved", F.col("number") > 14)


@r.query("citation_gaps", f"WITH {CITE}, g AS (SELECT unnest(range(1, 15)) AS number) SELECT number::INTEGER AS number FROM g WHERE number NOT IN (SELECT number FROM ct)")
def citation_gaps(spark, sf_dir):
    """DOC3: listed works that nothing cites."""
    listed = spark.range(1, 15).select(F.col("id").cast("int").alias("number"))
    return listed.join(D.citations(notes(spark, sf_dir), "id", "text").select("number").distinct(), "number", "left_anti")


CITED = {"name": r"\b[A-Z][a-z]+\s+et\s+al\b", "RFC": r"\bRFC\s+[0-9]+\b"}
REMARK = "concat('As Stone et al ', repeat('say ', p_size % 13), '[', p_size, '] and RFC ', p_size, ' too, ', p_name, ' is. See Flint et al', CASE WHEN p_partkey % 2 = 0 THEN ' [3].' ELSE '.' END)"


@r.query(
    "bare_citations",
    "WITH rm AS (SELECT p_partkey AS id, "
    + REMARK
    + """ AS text FROM part), c AS (SELECT 'name' AS kind, '\\b[A-Z][a-z]+\\s+et\\s+al\\b' AS pattern UNION ALL SELECT 'RFC', '\\bRFC\\s+[0-9]+\\b'),
        m AS (SELECT id, text, kind, regexp_extract_all(text, pattern) AS ms, regexp_split_to_array(text, pattern) AS ss FROM rm, c), f AS (SELECT *, unnest(range(1, len(ms) + 1)) AS n FROM m)
        SELECT id, kind, (n - 1)::INTEGER AS place, ms[n] AS cited FROM f
        WHERE NOT regexp_matches(substr(text, 1 + (list_sum(list_transform(ss[1:n], lambda x: len(x))) + list_sum(list_transform(ms[1:n], lambda x: len(x))))::BIGINT, 40), '\\[[0-9]+(?:, ?[0-9]+)*\\]')""",
)
def bare_citations(spark, sf_dir):
    """DOC3: works named without a marker close behind."""
    remarks = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr(REMARK).alias("text"))
    return D.bare_citations(remarks, "id", "text", CITED)


@r.query("first_appearance", f"WITH {CITE}, f AS (SELECT number, min(id * 100 + place) AS at_ FROM ct GROUP BY number) SELECT number, row_number() OVER (ORDER BY at_) AS new_number FROM f")
def first_appearance(spark, sf_dir):
    """DOC4."""
    return D.first_appearance(D.citations(notes(spark, sf_dir), "id", "text"), "id", "place", "number")


PHRASES = [("of the", "<P1>"), ("the", "<T>"), ("src1", "<S>"), ("licensed under", "<L>")]
MASKED = "text"
for _p, _to in sorted(PHRASES, key=lambda p: (-len(p[0]), p[0])):
    MASKED = f"replace({MASKED}, '{_p}', '{_to}')"


@r.query("mask", f"SELECT doc_id, sha256({MASKED}) AS masked_sha256, contains(lower({MASKED}), 'the') AS leaks FROM documents")
def mask(spark, sf_dir):
    """DOC5: masked longest first, and what leaks in another spelling."""
    m = X.mask(F.col("text"), PHRASES)
    return docs(spark, sf_dir).select("doc_id", F.sha2(m, 256).alias("masked_sha256"), F.contains(F.lower(m), F.lit("the")).alias("leaks"))


@r.query(
    "mask_leaks",
    "WITH bl AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN replace(text, 'the', '<T>') ELSE " + MASKED + " END AS text FROM documents) "
    + " UNION ALL ".join(f"SELECT doc_id, '{p}' AS leak FROM bl WHERE contains(text, '{p}')" for p, _ in PHRASES),
)
def mask_leaks(spark, sf_dir):
    """DOC5: phrases that masked copies still hold; a third of the copies were masked with one phrase only."""
    copy = F.when(F.col("doc_id") % 3 == 0, X.mask(F.col("text"), [p for p in PHRASES if p[0] == "the"])).otherwise(X.mask(F.col("text"), PHRASES))
    return docs(spark, sf_dir).select("doc_id", F.explode_outer(X.leaks(copy, PHRASES)).alias("leak")).filter("leak IS NOT NULL")


@r.query("n_of_m", f"WITH {NOTES}, q AS (SELECT DISTINCT id, unnest(regexp_extract_all(text, '\\b[0-9]+ of [0-9]+\\b')) AS pair FROM nt), s AS (SELECT id, CAST(split_part(pair, ' ', 1) AS BIGINT) AS n, CAST(split_part(pair, ' ', 3) AS BIGINT) AS m FROM q) SELECT id, n, m FROM s WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_size = s.n AND p_size = s.m)")
def n_of_m(spark, sf_dir):
    """DOC6: pairs that the reference set lacks."""
    known = read_table(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("n"), F.col("p_size").cast("long").alias("m")).distinct()
    return D.n_of_m(notes(spark, sf_dir), "id", "text").join(known, ["n", "m"], "left_anti").select("id", "n", "m")


@r.query("reconcile", "WITH a AS (SELECT o_orderkey AS k, 1 AS v FROM orders), x AS (SELECT o_orderpriority AS class, count(*)::BIGINT AS first FROM orders GROUP BY 1), y AS (SELECT o_orderpriority AS class, count(DISTINCT o_orderkey)::BIGINT AS second FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority <> '5-LOW' GROUP BY 1) SELECT class, coalesce(first, 0) AS first, coalesce(second, 0) AS second, coalesce(first, 0) - coalesce(second, 0) AS difference FROM x FULL JOIN y USING (class)")
def reconcile(spark, sf_dir):
    """DOC7."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("class"), F.lit(1).cast("long").alias("v"))
    b = o.filter("class <> '5-LOW'").join(read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")
    return D.reconcile(o, b, "class", "v")


@r.query("lists_agree", "WITH s AS (SELECT p_brand AS brand, array_to_string(list_sort(list_distinct(string_split(p_name, ' '))), ',') AS words FROM part) SELECT brand, count(DISTINCT words) AS variants, count(DISTINCT words) = 1 AS agree, min(len(string_split(words, ',')))::INTEGER AS least, max(len(string_split(words, ',')))::INTEGER AS most FROM s GROUP BY brand")
def lists_agree(spark, sf_dir):
    """DOC8: do the delimited lists of a group agree, and are their sizes in range."""
    words = F.array_sort(F.array_distinct(F.split("p_name", " ")))
    s = read_table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), words.alias("words"))
    return s.groupBy("brand").agg(F.count_distinct("words").alias("variants"), F.min(F.size("words")).alias("least"), F.max(F.size("words")).alias("most")).withColumn("agree", F.col("variants") == 1)


@r.query(
    "masked_diff",
    f"""WITH {NOTES}, cr AS (SELECT id, trim(regexp_replace(split_part(replace(replace(text, author, '<A>'), 'percent', '<P>'), 'None the', 1), '[ \\t\\r\\n]+', ' ', 'g')) AS t FROM nt), pr AS (SELECT a.id, a.t AS x, b.t AS y FROM cr a JOIN cr b ON b.id = a.id + 1)
        SELECT id, x = y AS equal, CASE WHEN x <> y THEN list_min(list_filter(range(1, least(len(x), len(y)) + 1), lambda i: x[i] <> y[i])) - 1 END::INTEGER AS at, len(x)::INTEGER AS left_length, len(y)::INTEGER AS right_length FROM pr""",
)
def masked_diff(spark, sf_dir):
    """DOC9: two copies up to a heading, masked and folded, and the first character at which they part."""
    n = notes(spark, sf_dir).select("id", F.replace("text", F.col("author"), F.lit("<A>")).alias("text"))
    other = n.select((F.col("id") - 1).alias("id"), F.col("text").alias("other"))
    return n.join(other, "id").select("id", D.masked_diff(F.col("text"), F.col("other"), [("percent", "<P>")], until="None the").alias("d")).select("id", "d.*")


@r.query(
    "pinned_rows_agree",
    f"""WITH {NOTES}, pn AS (SELECT DISTINCT concat(p_type, ' / ', p_size) AS pinned, concat('are ', p_type, ',') AS a, concat('Of these ', p_size, ' of') AS b FROM part WHERE p_size % 4 = 1), f AS (SELECT trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g')) AS t FROM nt)
        SELECT pinned, (SELECT count(*) FROM f WHERE contains(t, a)) AS cited, (SELECT count(*) FROM f WHERE contains(t, a) AND contains(t, b)) AS complete FROM pn""",
)
def pinned_rows_agree(spark, sf_dir):
    """DOC11: pinned rows whose pieces have to occur in the folded text."""
    pieces = F.array(F.concat(F.lit("are "), "p_type", F.lit(",")), F.concat(F.lit("Of these "), F.col("p_size").cast("string"), F.lit(" of")))
    pinned = read_table(spark, sf_dir, "part").filter("p_size % 4 = 1").select(F.concat("p_type", F.lit(" / "), F.col("p_size").cast("string")).alias("pinned"), pieces.alias("pieces")).distinct()
    return D.pinned_rows(notes(spark, sf_dir), "id", "text", pinned, "pinned", "pieces")


@r.query("word_limits", "SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ \\t\\r\\n]+'), lambda w: w <> ''))::INTEGER AS words, len(list_filter(regexp_split_to_array(text, '[ \\t\\r\\n]+'), lambda w: w <> '')) BETWEEN 50 AND 300 AS within FROM documents")
def word_limits(spark, sf_dir):
    """DOC12."""
    n = F.size(F.filter(F.split("text", "[ \t\r\n]+"), lambda w: w != ""))
    return docs(spark, sf_dir).select("doc_id", n.alias("words"), n.between(50, 300).alias("within"))


@r.query(
    "search_rows",
    """WITH u AS (SELECT 'page' AS kind, page_id AS id, coalesce(nullif(regexp_extract(url, '/([0-9]+)(\\?|#|$)', 1), ''), 'not captured') AS hits FROM pages UNION ALL SELECT 'event', event_id, coalesce(json_extract_string(props, '$.k'), 'not captured') FROM events)
       SELECT kind, count(*) AS n, count(*) FILTER (WHERE hits = 'not captured') AS not_captured, sum(TRY_CAST(hits AS BIGINT))::BIGINT AS hits FROM u GROUP BY kind""",
)
def search_rows(spark, sf_dir):
    """DOC10: unlike records in one schema; what is missing says so."""
    p = read_table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.nullif(F.regexp_extract("url", r"/([0-9]+)(\?|#|$)", 1), F.lit("")).alias("hits"))
    e = read_table(spark, sf_dir, "events").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.get_json_object("props", "$.k").alias("hits"))
    u = p.unionByName(e).fillna("not captured", ["hits"])
    return u.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("hits") == "not captured").alias("not_captured"), F.sum(F.expr("try_cast(hits AS BIGINT)")).alias("hits"))
