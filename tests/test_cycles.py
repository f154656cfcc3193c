"""Nodes on cycles against walking every way, where paths are far more than edges."""

import random

import pytest

from auditspark.operators import graph
from auditspark.plans import registry
from tests.test_graph import walk


def found(spark, edges):
    return sorted(r["node"] for r in graph.cycles(spark.createDataFrame(edges, "c long, p long"), "c", "p").collect())


@pytest.mark.parametrize("seed", [4, 5])
def test_equals_walking_every_way(spark, seed):
    """A long cycle, a chain into it, two cycles that touch, a loop on the way, ends that lead nowhere, repeated edges."""
    rng = random.Random(seed)
    edges = [(c, rng.choice([None, *range(9)])) for c in range(9) for _ in range(rng.randint(1, 3))] + [(40 + i, 40 + (i + 1) % 17) for i in range(17)] + [(70 + i, 71 + i) for i in range(8)]
    edges += [(78, 43), (45, 90), (90, 91), (91, 91), (91, 45), (95, 72), (95, 72), (96, 96), (97, 96)]
    assert found(spark, edges) == walk(edges)[1]


def test_all_above_all(spark):
    """More paths than can be walked; with edges that have no child."""
    edges = [(a, b) for a in range(30) for b in range(30) if a != b] + [(30, 0), (31, 30), (None, 5), (5, None)]
    assert found(spark, edges) == list(range(30))


def test_no_table_has_more_rows_than_edges(spark, monkeypatch):
    """nested_cycles used to walk all paths, some 50 for each part."""
    rows = []
    keep = graph.materialise

    def counted(df, name):
        kept = keep(df, name)
        rows.append(kept.count())
        return kept

    monkeypatch.setattr(graph, "materialise", counted)
    sf = "/root/testdata/sf0.01"
    assert registry.queries()["nested_cycles"](spark, sf).count() > 0
    assert max(rows) < 2 * spark.read.parquet(f"{sf}/part.parquet").count()
