"""Paths and cycles against walking every way; the chance of a miss against exact arithmetic."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from auditspark.functions import stats as S
from auditspark.operators import graph


def walk(edges):
    parents = {}
    for c, p in edges:
        parents.setdefault(c, set()).add(p)
    paths, cycles = [], set()

    def up(node, below):
        for p in parents.get(node, ()):
            if p is None:
                paths.append([node, *below])
            elif p not in below and p != node:
                up(p, [node, *below])

    for node in parents:
        up(node, [])
        seen, todo = set(), [p for p in parents[node] if p is not None]
        while todo:
            at = todo.pop()
            if at not in seen:
                seen.add(at)
                todo += [p for p in parents.get(at, ()) if p is not None]
        if node in seen:
            cycles.add(node)
    return sorted(paths), sorted(cycles)


def found(spark, edges):
    paths, cycles = graph.root_paths(spark.createDataFrame(edges, "c long, p long"), "c", "p")
    rows = paths.collect()
    assert all(r["node"] == r["path"][-1] and r["depth"] == len(r["path"]) - 1 for r in rows)
    return sorted(r["path"] for r in rows), sorted(r["node"] for r in cycles.collect())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_walking_every_way(spark, seed):
    """Diamonds, cycles that can and can't be reached, self-loops, nodes below nothing, roots that have parents too."""
    rng = random.Random(seed)
    edges = [(c, rng.choice([None, *range(14)])) for c in range(14) for _ in range(rng.randint(1, 2))] + [(20, 21), (21, 22), (22, 20), (30, 30), (40, 99), (50, None), (50, None), (51, 50), (52, 50), (53, 51), (53, 52), (54, 53), (54, 20)]
    assert found(spark, edges) == walk(edges)


def test_a_long_chain_takes_few_joins(spark, monkeypatch):
    rounds = []
    keep = graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df, name: (rounds.append(name), keep(df, name))[1])
    n = 5000
    paths, cycles = graph.root_paths(spark.range(n).select(F.col("id").alias("c"), F.when(F.col("id") > 0, F.col("id") - 1).alias("p")), "c", "p")
    last = paths.filter(f"node = {n - 1}").first()
    assert last["depth"] == n - 1 and last["path"] == list(range(n)) and paths.count() == n and cycles.isEmpty()
    assert rounds.count("met") < 20


def test_no_edges(spark):
    assert found(spark, []) == ([], [])


def miss(spark, rows):
    df = spark.createDataFrame(rows, "m long, total long, n long")
    return [r["x"] for r in df.select(S.log_miss(F.col("m"), F.col("total"), F.col("n")).alias("x")).collect()]


def exact(m, total, n):
    m, n = min(m, n), max(m, n)  # it is the same either way
    if total - m - n < 0:
        return float("-inf")
    return math.fsum(math.log1p(-n / (total - i)) if 2 * n < total else math.log((total - i - n) / (total - i)) for i in range(m))


def test_log_miss_equals_exact_arithmetic(spark):
    rng = random.Random(5)
    rows = [(m, total, n) for total in (1, 2, 5, 17, 40) for m in range(total + 1) for n in range(0, total + 1, 1 + total // 9)]
    rows += [(m, total, n) for total in (10**4, 10**6, 10**9, 10**12) for m in (1, 3, 20, total // 10**4, total - 5) for n in (1, 10, 10**3, total // 2, total - 20, total - 3, total) if min(m, n) < 200_000]
    rows += [(rng.randint(1, 10**5), 10**9, rng.randint(10**5, 10**8)) for _ in range(5)]
    for row, got in zip(rows, miss(spark, rows), strict=True):
        m, total, n = row
        if total <= 40:
            chance = Fraction(math.comb(total - m, n), math.comb(total, n))
            want = math.log(chance) if chance else float("-inf")
        else:
            want = exact(m, total, n)
        assert got == pytest.approx(want, rel=1e-9, abs=1e-9), row


def test_log_gamma(spark):
    xs = [0.5, 1.0, 1.5, 2.0, 7.25, 15.0, 16.0, 100.5, 1e5, 1e9]
    got = [r["g"] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(S.log_gamma(F.col("x")).alias("g")).collect()]
    assert got == pytest.approx([math.lgamma(x) for x in xs], rel=1e-9, abs=1e-9)
