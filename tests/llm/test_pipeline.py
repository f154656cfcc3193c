"""The pipeline's stages against brute force, each on what the one before it kept."""

from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
from auditspark.llm import toxicity
from auditspark.session import materialise
from tests.llm.test_ops import shingles, slow_best_fit, slow_components, slow_lines
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = materialise(stage(spark, docs, SF), "stage")
        out.append((name, docs, after))
        docs = after
    return out


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_columns_and_order(stages):
    assert [n for n, _, _ in stages] == ["toxicity", "line dedup", "MinHash near-dedup", "benchmark decontamination", "best-fit packing"]
    for _, before, after in stages[:-1]:
        assert after.dtypes == before.dtypes


def test_toxicity(spark, stages):
    _, before, after = stages[0]
    judged = toxicity.judge(before, spark.read.parquet(f"{SF}/labels.parquet"))
    assert {d for d, _ in rows(after)} == {r["doc_id"] for r in judged.collect() if not r["toxic"]}
    assert Counter(rows(after)) == Counter(r for r in rows(before) if r[0] in {d for d, _ in rows(after)})


def test_lines(stages):
    _, before, after = stages[1]
    want = slow_lines(rows(before))
    assert dict(rows(after)) == {d: w[2] for d, w in want.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect() if want[r["doc_id"]][1])


def test_near(stages):
    _, before, after = stages[2]
    want = slow_components(rows(before), 5, 80)
    assert sorted(d for d, _ in rows(after)) == sorted(d for d, (_, c) in want.items() if c == d)


def test_decontamination(spark, stages):
    _, before, after = stages[3]
    items = [shingles(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {d for d, t in rows(before) if any(s and len(s & shingles(t)) >= 0.8 * len(s) for s in items)}
    assert {d for d, _ in rows(after)} == {d for d, _ in rows(before)} - bad


def test_packing(stages):
    _, before, after = stages[4]
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = after.collect()
    parts = {}
    for r in sorted(got, key=lambda r: r["piece"]):
        assert r["length"] == len(r["ids"]) and r["start"] == len(parts.setdefault(r["doc_id"], []))
        parts[r["doc_id"]] += r["ids"]
    assert parts == {d: [*plain.encode(t, add_special_tokens=False).ids, 2] for d, t in rows(before)}
    per = Counter()
    for r in got:
        per[r["doc_id"]] += r["length"]
    assert per == {d: len(plain.encode(t, add_special_tokens=False).ids) + 1 for d, t in rows(before)}
    assert len({r["sequence_id"] for r in got}) == len(slow_best_fit([r["length"] for r in got], 1024))


def test_run_is_the_stages(spark, stages):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert Counter(corpus_pipeline.run(spark, SF).select(*columns).collect()) == Counter(stages[-1][2].select(*columns).collect())


def test_stages_do_their_own_odd_input(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "x", None, None, 1), (2, "", "en", "s", 0), (3, "a b", "en", "s", 3), (3, "a b", "en", "s", 3), (4, "y" * 50_000, "en", "s", 50_000)], schema)
    left = {name: Counter(r["doc_id"] for r in stage(spark, odd, SF).collect()) for name, stage in corpus_pipeline.STAGES}
    ids = Counter([1, None, 2, 3, 3, 4])
    # nothing here is toxic, repeated in five documents or a benchmark item; equal rows share an id, so both stay
    assert [left[name] for name, _ in corpus_pipeline.STAGES[:-1]] == [ids] * 4
    assert set(left["best-fit packing"]) == set(ids) and left["best-fit packing"][3] == 2
    assert all(stage(spark, odd.limit(0), SF).count() == 0 for _, stage in corpus_pipeline.STAGES)
