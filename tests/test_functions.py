"""Rules, text, statistics and record operators on small inputs, ties, nulls and broken input."""

import math
import random

import pytest
from pyspark.sql import functions as F

from auditspark.functions import rules as R
from auditspark.functions import stats as S
from auditspark.functions import text as X
from auditspark.operators import census as C
from auditspark.operators import claims as G
from auditspark.operators import findings as M
from auditspark.operators import prose as D
from auditspark.operators import records as L
from auditspark.operators import sampling as P
from auditspark.plans.vocabulary import BANNER, MESSAGE_STEPS, SEVERITY
from auditspark.session import scratch_path
from auditspark.sources import jsonl, tables

RULES = [("a", "first", "^x"), ("b", "second", "y"), ("c", "third", "xy")]


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("value", "want"),
    [(None, ("absent", "null")), ("  ", ("absent", "empty string")), (" XY ", ("a", "first")), ("zy", ("b", "second")), ("q" * 70, ("unclassified", "q" * 60))],
)
def test_classify_first_match_wins(spark, value, want):
    assert tuple(one(spark, lambda v: R.classify(v, RULES), value)) == want


def test_classify_distinct_keeps_rows(spark):
    df = spark.createDataFrame([(k, v) for k, v in enumerate([None, "", "xy", "xy", None])], "k int, v string")
    got = {r["k"]: r["category"] for r in R.classify_distinct(df, "v", RULES).collect()}
    assert got == {0: "absent", 1: "absent", 2: "a", 3: "a", 4: "absent"}


def test_extension_never_overrides(spark):
    f = lambda v: R.classify_extended(v, RULES, [("z", "extra", "q|x")])
    assert tuple(one(spark, f, "x")) == ("a", "first", False)
    assert tuple(one(spark, f, "q")) == ("z", "extra", True)
    assert tuple(one(spark, f, "w")) == ("unclassified", "w", False)


def test_three_states_stay_apart(spark):
    rows = [("{}", "absent"), ('{"a": null}', "empty"), ('{"a": ""}', "empty"), ('{"a": "x"}', "non_empty")]
    assert [one(spark, lambda v: R.json_state(v, "$.a"), j) for j, _ in rows] == [s for _, s in rows]
    assert [one(spark, R.three_state, v) for v in (None, " ", "x")] == ["absent", "empty", "non_empty"]


def test_macro_states(spark):
    kind = "array<struct<a string, b string>>"
    f = lambda v: R.macro_state(v, ["a", "b"])
    assert one(spark, f, None, kind)["state"] == "absent"
    assert one(spark, f, [], kind)["state"] == "present_zero_items"
    assert tuple(one(spark, f, [("x", " ")], kind)) == ("present_incomplete", ["b"])
    assert tuple(one(spark, f, [("x", "y")], kind)) == ("present_complete", [])


def test_messages_of_one_class_collapse(spark):
    f = lambda c: X.normalise_message(c, MESSAGE_STEPS)
    assert one(spark, f, "Missing Element=<A> in frame 1") == one(spark, f, "Missing Element=<A> in frame 17")
    assert one(spark, f, "Missing Element=<A>") != one(spark, f, "Missing Element=<B>")
    assert one(spark, f, "under 1.2.840.10008.5 and 'x'") == "under <uid> and <quoted>"
    assert one(spark, f, "VR 16 of Type 2") != one(spark, f, "VR 32 of Type 2")
    assert one(spark, f, "(0x0008,0x0060) Value=abc in frame #7") == one(spark, f, "(0x0010,0x0020)  value = <x y> in Frame 12").replace("Frame", "frame")
    assert one(spark, f, "number 4, item 5, index  6") == "number <n>, item <n>, index <n>"


def test_spelling_clip_mask(spark):
    assert one(spark, X.normalise_spelling, " HTTPS://Host:a/b.git") == "host/a/b"
    assert one(spark, lambda v: X.clip(v, 5), "abcd efgh") == "abcd ..."
    assert one(spark, lambda v: X.mask(v, [("ab", "1"), ("abc", "2")]), "abcab") == "21"
    assert one(spark, X.strip_markup, "<p>a ‑ b</p> <b>c</b> , d") == "a - b c, d"


def test_wilson(spark):
    w = spark.range(1).select(S.wilson(F.lit(5), F.lit(10)).alias("w"), S.wilson(F.lit(0), F.lit(0)).alias("e"), S.wilson(F.lit(0), F.lit(3)).alias("z")).first()
    assert w["w"]["lo"] == pytest.approx(0.2366, abs=1e-4) and w["w"]["hi"] == pytest.approx(0.7634, abs=1e-4)
    assert w["e"]["lo"] is None and w["z"]["lo"] == pytest.approx(0, abs=1e-12)


def test_icc_of_separated_clusters(spark):
    df = spark.createDataFrame([("g", c, float(c)) for c in range(4) for _ in range(5)], "g string, c int, y double")
    r = S.icc(df, ["g"], "c", "y").first()
    assert (r["clusters"], r["m0"], r["icc"]) == (4, 5.0, 1.0)
    assert S.icc(df.withColumn("y", F.lit(1.0)), ["g"], "c", "y").first()["icc"] is None
    assert S.icc(df.filter("c = 1"), ["g"], "c", "y").first()["icc"] is None


def test_expected_clusters_edges(spark):
    f = lambda m, total, n: spark.range(1).select(S.log_miss(F.lit(m), F.lit(total), F.lit(n)).alias("r")).first()["r"]
    assert f(10, 30, 30) == -math.inf and f(10, 30, 0) == 0.0
    want = math.log(math.comb(900, 10) / math.comb(1000, 10))
    assert f(100, 1000, 10) == pytest.approx(want, abs=1e-12)


def test_design_effect(spark):
    assert spark.range(1).select(S.design_effect(F.lit(11), F.lit(0.9)).alias("r")).first()["r"] == pytest.approx(10)


def test_kappa(spark):
    df = spark.createDataFrame([(1, 1)] * 20 + [(1, 0)] * 5 + [(0, 1)] * 10 + [(0, 0)] * 15 + [(None, 1)], "a int, b int")
    assert S.kappa(df, "a", "b").first()["kappa"] == pytest.approx(0.4)
    assert S.kappa(df.filter("a = 1 AND b = 1"), "a", "b").first()["kappa"] is None


def test_both_ways_counts_are_exact(spark):
    df = spark.createDataFrame([("u", k < 1) for k in range(30_000)] + [("v", True)] * 3 + [("w", False)], "unit string, flag boolean")
    r = C.both_ways(df, "unit", F.col("flag")).first()
    assert (r["units_none"], r["units_all"], r["units_between"]) == (1, 1, 1)  # 1 of 30,000 is not none


LOG = [("A", 0, "FAILED", None), ("A", 1, "OK", "x"), ("B", 2, "OK", "x"), ("B", 3, "FAILED", None), ("C", 4, "OK", "x"), ("C", 5, "OK", "y"), ("D", 6, "OK", "x"), (None, 7, "FAILED", None)]


def test_merge_attempts(spark):
    df = spark.createDataFrame(LOG, "k string, o long, status string, v string")
    got = {r["k"]: (r["o"], r["kept_ok"], r["v"], r["duplicates"], r["failures"], r["disagreements"]) for r in L.merge_attempts(df, "k", "o", F.col("status") == "OK", ["v"]).collect()}
    assert got == {"A": (1, True, "x", 1, 1, 0), "B": (2, True, "x", 1, 1, 0), "C": (4, True, "x", 1, 0, 1), "D": (6, True, "x", 0, 0, 0), None: (7, False, None, 0, 1, 0)}


def test_merge_of_random_logs(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(20), o, rng.choice(["OK", "FAILED"]), rng.choice(["x", "y", None])) for o in range(300)]
    want = {}
    for k, o, status, v in rows:
        kept = want.get(k)
        if kept is None or (status == "OK" and kept[1] != "OK"):
            want[k] = (o, status, v)
    got = L.merge_attempts(spark.createDataFrame(rows, "k long, o long, status string, v string"), "k", "o", F.col("status") == "OK", ["v"]).collect()
    assert {r["k"]: r["o"] for r in got} == {k: w[0] for k, w in want.items()}
    for r in got:
        oks = [v for k, _, s, v in rows if k == r["k"] and s == "OK"]
        assert r["disagreements"] == sum(v != want[r["k"]][2] for v in oks) if r["kept_ok"] else r["disagreements"] == 0


def test_broken_lines_are_counted(spark):
    path = scratch_path(spark, "log")
    spark.createDataFrame([('{"uid": 1}',), ("",), ('{"uid": 2',), ('{"other": 3}',), ("[1]",)], "value string").coalesce(1).write.text(path)
    from pyspark.sql import types as Y

    lines = jsonl.read_lines(spark, path, Y.StructType([Y.StructField("uid", Y.LongType())]), "uid")
    n = jsonl.line_counts(lines).first()
    assert n["lines_seen"] == 4 and n["unparsable"] + n["wrong_shape"] == 3 and n["unparsable"] >= 1
    assert [r["uid"] for r in jsonl.records(lines).collect()] == [1]


def test_publish_refuses_partial(spark):
    path = scratch_path(spark, "t")
    assert tables.publish(spark.range(10), path, 10)
    assert not tables.publish(spark.range(5), path, 10)
    assert tables.published(spark, path).count() == 10
    assert tables.publish(spark.range(12), path, 10) and tables.published(spark, path).count() == 12
    assert tables.publish(spark.range(13), path, 10) and tables.versions(spark, path) == [1, 2]


def test_nothing_published(spark):
    with pytest.raises(FileNotFoundError):
        tables.published(spark, scratch_path(spark, "t"))


def test_sticky_retirement_survives(spark):
    old = spark.createDataFrame([("1", "a", "RETIRED"), ("2", "b", "MEASURED")], "id string, claim string, status string")
    new = spark.createDataFrame([("1", "c", "MEASURED"), ("3", "d", "PENDING")], "id string, claim string, status string")
    got = {r["id"]: (r["claim"], r["status"]) for r in G.sticky_upsert(old, new, "id", {"status": "RETIRED"}).collect()}
    assert got == {"1": ("c", "RETIRED"), "2": ("b", "MEASURED"), "3": ("d", "PENDING")}


def test_violations(spark):
    rows = spark.createDataFrame([("1", "x", "NO"), ("2", " ", "OK"), ("2", "y", "OK")], "id string, claim string, status string")
    assert {tuple(r) for r in G.violations(rows, "id", ["OK"], ["claim"]).collect()} == {("1", "invalid status"), ("2", "missing claim"), ("2", "duplicate id")}


def test_proposals_of_each_shape(spark):
    files = [("a", '[{"id": "1", "claim": "x", "note": "n"}, {"id": "2"}]'), ("b", '{"track": "t", "rows": [{"id": "3", "status": "OK"}]}'), ("c", ' {"id": "4"}'), ("d", "[{"), ("e", None)]
    rows = G.proposed_rows(spark.createDataFrame(files, "file string, content string"), "file", F.col("content"), ["id", "claim", "status"])
    got = [(r["file"], r["id"], r["claim"], r["status"], r["unknown"], r["present"]) for r in rows.orderBy("file", "place").collect()]
    assert got[:4] == [("a", "1", "x", None, ["note"], ["id", "claim"]), ("a", "2", None, None, [], ["id"]), ("b", "3", None, "OK", [], ["id", "status"]), ("c", "4", None, None, [], ["id"])]
    assert [g[:4] for g in got[4:]] == [("d", None, None, None), ("e", None, None, None)]
    old = spark.createDataFrame([("1", "y", "RETIRED"), ("4", "z", "OK")], "id string, claim string, status string")
    judged = {r["id"]: (r["dropped"], r["decision"]) for r in G.judge_proposals(rows.filter("id IS NOT NULL"), old, ["OK"], F.col("id") == "3", ["status"]).collect()}
    assert judged == {"1": (1, "rewords a retired row"), "2": (0, "accepted"), "3": (0, "new pre-registration"), "4": (0, "accepted")}


def test_all_or_nothing(spark):
    rows = spark.createDataFrame([("1", "x", "NO"), ("2", "y", "OK")], "id string, claim string, status string")
    good = rows.filter("status = 'OK'")
    assert G.all_or_nothing(rows, G.violations(rows, "id", ["OK"], ["claim"])).isEmpty()
    assert G.all_or_nothing(good, G.violations(good, "id", ["OK"], ["claim"])).count() == 1


def test_chain_ends(spark):
    long = [(str(k), str(k + 1)) for k in range(300)]
    cycle = [("a", "b"), ("b", "a"), ("c", "a"), ("s", "s"), ("end", None), ("lost", "nowhere")]
    got = {r["id"]: (r["last"], r["hops"]) for r in G.chain_ends(spark.createDataFrame(long + cycle, "id string, next string")).collect()}
    want = {str(k): ("300", 300 - k) for k in range(300)} | dict.fromkeys("abcs", (None, None)) | {"lost": ("nowhere", 1)}
    assert got == want
    assert G.chain_ends(spark.createDataFrame([], "id string, next string")).isEmpty()


def test_bare_citations(spark):
    text = "Stone et al say [1]. Flint et al" + " x" * 20 + " [2]. RFC 12 and Reed et al [3]. Moss et al"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, text string")
    got = {(r["id"], r["kind"], r["cited"]) for r in D.bare_citations(df, "id", "text", {"name": r"\b[A-Z][A-Za-z]+\s+et\s+al\b", "RFC": r"\bRFC\s+[0-9]+\b"}).collect()}
    assert got == {(1, "name", "Flint et al"), (1, "name", "Moss et al")}


def test_masked_diff_and_leaks(spark):
    pairs = [("a  b", "a b"), ("a bcd e", "a bcx e"), ("ab", "ab c"), ("ab c", "abd c"), (None, "x"), ("", None), ("\U0001f600 ab", "\U0001f600 ac"), ("one # End x", "two # End y")]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, x string, y string")
    got = {r["k"]: (r["d"]["equal"], r["d"]["at"]) for r in df.select("k", D.masked_diff(F.col("x"), F.col("y"), [("two", "one")], until="# End").alias("d")).collect()}
    assert got == {0: (True, None), 1: (False, 4), 2: (False, None), 3: (False, 2), 4: (False, None), 5: (True, None), 6: (False, 3), 7: (True, None)}
    assert one(spark, lambda v: X.leaks(v, [("ab", "1"), ("abc", "2"), ("z", "3")]), "xabcab") == ["ab", "abc"]


def test_overlap_of_sets(spark):
    rows = [("c", g, i) for g, ids in (("l", range(6)), ("r", range(7))) for i in ids] + [("d", "l", 1)]
    grid = spark.createDataFrame([("c",), ("d",), ("e",)], "cell string")
    got = {r["cell"]: r for r in M.overlap(spark.createDataFrame(rows, "cell string, g string, i int"), ["cell"], "g", "l", "r", "i", grid).collect()}
    assert (got["c"]["jaccard"], got["c"]["direction"]) == (0.8571, "subset")
    assert (got["d"]["jaccard"], got["d"]["direction"]) == (0.0, "superset")
    assert got["e"]["vacuous"] and got["e"]["jaccard"] == 1.0


def test_nested_prefix_sample(spark):
    df = spark.range(500).select(F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("s"), F.col("id").alias("u"))
    draw = lambda n: {(r["s"], r["u"]) for r in P.draw(df, spark.createDataFrame([(f"s{k}", n) for k in range(3)], "s string, n long"), "s", "u", 7).collect()}
    small, large = draw(10), draw(25)
    assert len(small) == 30 and len(large) == 75 and small < large


def test_budget_is_kept(spark):
    strata = spark.createDataFrame([("a", 1000, 5.0, 2.0), ("b", 100, 1.0, 0.5), ("c", 5000, 20.0, 30.0)], "stratum string, series long, mean_mb double, sd_mb double")
    rows = P.allocate(strata, 2500.0).collect()
    assert sum(r["expected_mb"] for r in rows) <= 2500 and {r["stratum"]: r["n"] for r in rows}["b"] == 100
    assert all(r["n"] == min(384, r["series"]) for r in P.allocate(strata, 1e9).collect())


def test_prose(spark):
    df = spark.createDataFrame([(1, "We saw 12 of 30. It has 1,234 items [2, 3] and v1.2.3.\n\nNo data [1]"), (2, None)], "id int, text string")
    assert [r["sentence"] for r in D.sentences(df, "id", "text").collect()][0] == "We saw 12 of 30."
    assert {(r["n"], r["m"]) for r in D.n_of_m(df, "id", "text").collect()} == {(12, 30)}
    assert {r["number"] for r in D.numbers(df, "id", "text").collect()} == {"1,234"}
    assert [r["number"] for r in D.citations(df, "id", "text").orderBy("place").collect()] == [2, 3, 1]


def test_findings_without_a_banner_stay_findings(spark):
    logs = spark.createDataFrame([(1, "no type here\nSegmentation\nError - x"), (2, "CTImage\n\nMRImage\na - Warning - y"), (3, ""), (4, None)], "uid long, log string")
    got = {(r["uid"], r["line"]): r["severity"] for r in M.split_findings(logs, ["uid"], "log", SEVERITY, BANNER).collect()}
    assert got == {(1, "no type here"): "UNCLASSIFIED", (1, "Segmentation"): "BANNER", (1, "Error - x"): "Error", (2, "CTImage"): "BANNER", (2, "MRImage"): "UNCLASSIFIED", (2, "a - Warning - y"): "Warning"}


def test_prefixed_logs_are_parsed(spark):
    log = "W: Testing: /tmp/a b\nE: bad\nW: odd\nI: note\nplain\nW: x - Error - said\n\nW: Test passed."
    got = [(r["kind"], r["severity"], r["message"]) for r in M.split_prefixed(spark.createDataFrame([(1, log), (2, None)], "uid long, log string"), ["uid"], "log", SEVERITY).orderBy("pos").collect()]
    assert got == [("banner", None, "W: Testing: /tmp/a b"), ("finding", "Error", "E: bad"), ("finding", "Warning", "W: odd"), ("finding", "UNCLASSIFIED", "I: note"), ("finding", "UNCLASSIFIED", "plain"), ("finding", "Error", "W: x - Error - said"), ("passed", None, "W: Test passed.")]


def test_equal_tables_have_no_difference(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (None, None)], "k long, f string")
    assert M.table_difference(a, a).first().asDict() == {"only_first": 0, "only_second": 0, "equal": True, "first_difference": None, "side": None}
    assert M.table_difference(a, a.distinct()).first().asDict() == {"only_first": 1, "only_second": 0, "equal": False, "first_difference": "1|x", "side": "first"}


def test_inheritance_needs_both_attributes(spark):
    t = "class string, collection string, maker string, model string"
    acquired = spark.createDataFrame([("A", "c1", "m", "x"), ("A", "c2", " m ", "y"), ("A", "c1", None, None), ("A", "c1", "", "z")], t)
    derived = spark.createDataFrame([("D", "c1", "m", "x"), ("D", "c2", "m", " x"), ("D", "c1", "m", "y"), ("D", "c1", None, None), ("D", "c1", "", "z"), ("E", "c1", None, "x")], t)
    got = {r["class"]: tuple(r)[1:] for r in C.inherited(derived, acquired, ["class"], ["maker", "model"], ["collection"]).collect()}
    assert got == {"D": (5, 3, 1, 33.33), "E": (1, 0, 0, 0.0)}
    got = {r["class"]: tuple(r)[1:] for r in C.inherited(derived, acquired, ["class"], ["maker", "model"], []).collect()}
    assert got == {"D": (5, 3, 3, 100.0), "E": (1, 0, 0, 0.0)}


def test_search_fields_are_decoded(spark):
    df = spark.createDataFrame([("http://x/?q=a%20b+c", "<title>t</title> 1,234 hits"), ("http://x/2", "<title> t </title>"), ("http://x/?q=%zz", None)], "url string, html string")
    got = [tuple(r) for r in df.select(*[v.alias(c) for c, v in C.search_fields(F.col("url"), F.col("html")).items()]).collect()]
    assert got == [("not captured", "a b c", "1234"), ("not captured", "t", "not captured"), ("not captured", "not captured", "not captured")]


@pytest.mark.parametrize("half", [0.2, 0.05, 0.013, 0.001])
def test_smallest_n_is_the_smallest(spark, half):
    z = S.Z
    width = lambda p, n: z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    rates = [0.0, 1e-9, 0.001, 0.02, 0.3, 0.5, 0.97, 1.0]
    df = spark.createDataFrame([(p,) for p in rates], "p double")
    for p, n in df.select("p", S.smallest_n(F.col("p"), F.lit(half))).collect():
        assert width(p, n) <= half and (n == 1 or width(p, n - 1) > half)


def test_byte_gate_shrinks_until_the_draw_fits(spark):
    rows = [(f"s{k % 3}", k, float(k % 50) + 1) for k in range(6000)]
    df = spark.createDataFrame(rows, "stratum string, uid long, mb double")
    strata = df.groupBy("stratum").agg(F.count("*").alias("series"), F.avg("mb").alias("mean_mb"))
    ranked = P.rank(df, "stratum", "uid", 7, "mb")
    assert ranked.groupBy("stratum").count().agg(F.max("count")).first()[0] == 384
    first = P.drawn_size(ranked, P.allocate_at(strata, 5000.0), "stratum", "mb")
    got = P.byte_gate(ranked, strata, "stratum", "mb", 5000.0, 0.5 * first)
    assert P.drawn_size(ranked, got, "stratum", "mb") <= 0.5 * first
    fired = got.first()["fired"]
    assert P.drawn_size(ranked, P.allocate_at(strata, 5000.0 * 0.95 ** (fired - 1)), "stratum", "mb") > 0.5 * first
    with pytest.raises(ValueError):
        P.byte_gate(ranked, strata, "stratum", "mb", 5000.0, 1.0)
