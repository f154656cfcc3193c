"""Ranked search against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from auditspark.llm import ranked_search
from tests.llm.test_ops import ODD, SF, documents, table

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def slow_search(docs, items, k=10):
    own = [(i, Counter(terms(t))) for i, t in docs]
    own = [(i, c, c.total()) for i, c in own if c]
    n, length = len(own), sum(x[2] for x in own)
    df = Counter(t for _, c, _ in own for t in c)
    wanted = {}
    for i, t in items:
        if i is not None:
            wanted.setdefault(i, Counter()).update(terms(t))
    out = []
    for item, query in wanted.items():
        scored = []
        for i, c, size in own:
            m = 100 - 75 + (75 * size * n) // length
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t, times in query.items() if t in c)
            if score > 0 and i is not None:
                scored.append((-score, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def items_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "item_id long, text string, doc_id int, score int")


def found(df):
    return sorted((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("block", [ranked_search.BLOCK, 500])
def test_equals_scoring_every_document(spark, monkeypatch, block):
    monkeypatch.setattr(ranked_search, "BLOCK", block)
    docs = documents(spark)
    docs += [(4000 + k, docs[k % 4][1]) for k in range(40)]  # ties
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    items += [(900, docs[3][1]), (901, "the the THE of"), (902, None), (903, ""), (904, "!?"), (None, "the"), (905, "nowhere12345"), (0, "more of item zero")]
    got = ranked_search.search(table(spark, docs).repartition(3), items_of(spark, items))
    assert found(got) == slow_search(docs, items)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]


def test_several_passes(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "QUERY_TERMS", 100)
    docs = documents(spark, 60)
    items = [(k, " ".join(docs[k][1].split()[:25])) for k in range(12)]
    assert found(ranked_search.search(table(spark, docs), items_of(spark, items), 3)) == slow_search(docs, items, 3)


def test_odd(spark):
    docs = [*ODD, (9, "Word, wOrd; WORD"), (9, "Word, wOrd; WORD"), (10, "naïve Ünï  İx 漢字。text"), (11, "x" * 3), (12, "a-b_c.d'e")]
    items = [(1, "word"), (2, "ünï Ünï"), (3, "漢字 text e"), (4, "no id here"), (5, "A B C D E F")]
    assert found(ranked_search.search(table(spark, docs), items_of(spark, items))) == slow_search(docs, items)
    assert found(ranked_search.search(table(spark, []), items_of(spark, items))) == []
    assert found(ranked_search.search(table(spark, docs), items_of(spark, []))) == []


def test_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(ranked_search, "PIECE", 7)
    text = "One two, three-four the one twö " * 9
    want = Counter(terms(text))
    n, own = ranked_search.term_counts(text, {t.encode(): k for k, t in enumerate(want)})
    assert (n, own) == (want.total(), {k: c for k, c in enumerate(want.values())})


@pytest.mark.parametrize("seed", range(5))
def test_limited_accumulators_keep_the_best(seed):
    """Blocks with rare and very common terms: accumulators stop being made, and the k best stay exact."""
    rng = random.Random(seed)
    docs = [Counter(rng.choices(range(12), [1, 1, 2, 3, 5, 8, 40, 80, 120, 200, 400, 800], k=rng.randint(1, 60))) for _ in range(3000)]
    n = np.array([c.total() for c in docs])
    row = np.repeat(np.arange(3000), [len(c) for c in docs])
    term, tf = (np.array([x[k] for c in docs for x in c.items()], "i4") for k in (0, 1))
    corpus = (3000, int(n.sum()))
    block = ranked_search.Block(np.arange(3000) * 3 + 1, n, row, term, tf, corpus)
    df = Counter(t for c in docs for t in c)
    query = sorted(((t, ranked_search.weight(3000, df[t])) for t in range(12)), key=lambda x: df[x[0]])
    m = 25 + (75 * n * 3000) // corpus[1]
    scores = np.array([sum(w * ((10**9 * c[t]) // (1000 * c[t] + 8 * int(m[k]))) for t, w in query if t in c) for k, c in enumerate(docs)])
    want = ranked_search.top(block.ids, scores, 10)
    ids, own = block.best(query, 10)
    got = ranked_search.top(ids, own, 10)
    assert [x.tolist() for x in got] == [x.tolist() for x in want]
    assert np.count_nonzero(block.sums) < 3000  # the last terms made none
    ids, own = block.best(query, 10, int(want[1][4]))
    assert [x[:5].tolist() for x in ranked_search.top(ids, own, 10)] == [x[:5].tolist() for x in want]
