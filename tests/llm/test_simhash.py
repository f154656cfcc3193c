"""SimHash near-dedup against brute force: fingerprints, BK-trees, shards, components."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from auditspark.llm import components, simhash, skew
from auditspark.llm.skew import join_unique
from tests.llm.test_ops import ODD, documents, table


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", words) if w]
    runs = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_labels(prints, radius=3):
    """The number of the first of each component."""
    label = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label


def slow_components(rows, radius=3):
    prints = [slow_fingerprint(t) for _, t in rows]
    label = slow_labels(prints, radius)
    least = {}
    for (i, _), k in zip(rows, label, strict=True):
        least[k] = min(i, least.get(k, i))
    return sorted((i, p, least[k]) for (i, _), p, k in zip(rows, prints, label, strict=True))


TEXTS = ["", " ", None, "one", "One  two", "a b c", "a b c d", "A\tB\x0bC\nd", "é É ß İ", "x y z w", "w " * 5000, "漢字 かな 🙂 end"]


@pytest.mark.parametrize("piece", [1, 7, 2**20])
def test_fingerprint_equals_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(simhash, "PIECE", max(piece, 64) if piece > 1 else 64)
    for text in [*TEXTS, *(t for _, t in documents(spark, 40))]:
        assert simhash.fingerprint(text) == slow_fingerprint(text), text


def test_words_of_a_piece_are_whole(monkeypatch):
    monkeypatch.setattr(simhash, "PIECE", 5)
    assert [w for found in simhash.word_lists("ab  cdefghij k\x0bl mno " * 3) for w in found] == [b"ab", b"cdefghij", b"k", b"l", b"mno"] * 3


def near(rng, center, flips):
    for b in rng.sample(range(64), flips):
        center ^= 1 << b
    return center


@pytest.mark.parametrize("seed", range(6))
def test_forest_equals_brute_force(seed):
    """Random and clustered fingerprints, chains of links, shards of very different sizes."""
    rng = random.Random(seed)
    shards = []
    for size in (1, 1, 2, 5, 30, 200, 3):
        center, found = rng.getrandbits(64), set()
        while len(found) < size:
            found.add(rng.getrandbits(64) if rng.random() < 0.2 else near(rng, rng.choice([center, *found]), rng.randint(0, 5)))
        shards.append(list(found))
    x = np.array([p for s in shards for p in s], "u8")
    shard = np.repeat(np.arange(len(shards)), [len(s) for s in shards])
    want, at = [], 0
    for s in shards:
        want += [at + k for k in slow_labels(s)]
        at += len(s)
    assert simhash.Forest(x, shard).connected().tolist() == want


def test_search_follows_only_edges_within_the_radius():
    rng = random.Random(5)
    x = np.array(list({rng.getrandbits(64) for _ in range(2000)}), "u8")
    forest = simhash.Forest(x, np.zeros(len(x), "i8"))
    q, node = forest.search(np.arange(0, 2000, 50), np.zeros(len(x), bool))
    want = {(i, j) for i in range(0, 2000, 50) for j in range(len(x)) if (int(x[i]) ^ int(x[j])).bit_count() <= 3}
    assert set(zip(q.tolist(), node.tolist(), strict=True)) == want
    gone = np.ones(len(x), bool)
    forest.remove(np.arange(len(x)))
    assert not forest.left.any() and not len(forest.search(np.arange(10), gone)[0])


def test_shards_are_bounded_and_lose_no_link(spark):
    """A third of the fingerprints round one center: its shards are dealt again until they are small."""
    rng = random.Random(2)
    prints = {near(rng, 2**40 + 5, rng.randint(1, 4)) for _ in range(300)} | {rng.getrandbits(64) for _ in range(300)}
    reps = spark.createDataFrame([(k, p - 2**64 if p >> 63 else p) for k, p in enumerate(sorted(prints))], "rep long, fp long")
    keyed = simhash.shards(reps, most=60)
    assert keyed.groupBy("mask", "value").count().agg(F.max("count")).first()[0] <= 60
    together = {}
    for r in keyed.collect():
        together.setdefault((r["mask"], r["value"]), []).append(r)
    met = {(a["rep"], b["rep"]) for s in together.values() for a in s for b in s}
    order = sorted(prints)
    assert all((i, j) in met for i in range(len(order)) for j in range(len(order)) if (order[i] ^ order[j]).bit_count() <= 3)


def test_components_equal_brute_force(spark):
    docs = documents(spark)
    docs += [(5000 + k, t + " and more") for k, (_, t) in enumerate(docs[:60])] + [(6000 + k, docs[k % 3][1]) for k in range(90)]
    docs += [(7000 + k, t) for k, t in enumerate(TEXTS)]
    got = simhash.near_copies(table(spark, docs)).collect()
    assert sorted((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in got) == slow_components(docs)


def test_odd(spark):
    got = simhash.near_copies(table(spark, ODD)).collect()
    assert len(got) == len(ODD) and [r["component_id"] for r in got if r["doc_id"] is None] == [None]
    zero = {r["doc_id"]: r["component_id"] for r in got if r["fp"] == 0}
    assert zero == {1: 1, 2: 1, 3: 1, 7: 1}
    assert simhash.near_copies(table(spark, [])).collect() == []


def test_a_hot_key_stays_where_it_is(spark, monkeypatch):
    monkeypatch.setattr(skew, "ONE_TASK", 100)
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), "id")
    named = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("m"))
    got = join_unique(rows, named, ["k"])
    assert got.count() == 3000 and got.columns == ["k", "id", "m"]
    assert got.filter("k = 7").count() == 1001  # and the row whose own id is 7
    assert "BroadcastHashJoin" in got._jdf.queryExecution().toString()


def test_components_where_a_node_has_a_third_of_all_links(spark, monkeypatch):
    monkeypatch.setattr(skew, "ONE_TASK", 10)
    monkeypatch.setattr(components, "ONE_TASK", 10)
    rng = random.Random(8)
    links = [(5, k) for k in range(100, 300)] + [(rng.randint(1000, 1400), rng.randint(1000, 1400)) for _ in range(400)] + [(300, 7), (7, 299), (1, 1), (None, 4)]
    label = {x: x for ab in links for x in ab if x is not None and ab[0] != ab[1] and None not in ab}
    for _ in range(60):
        for a, b in links:
            if a in label and b in label:
                label[a] = label[b] = min(label[a], label[b])
    got = components.connected_components(spark.createDataFrame(links, "a long, b long"))
    assert {r["node"]: r["component"] for r in got.collect()} == label
