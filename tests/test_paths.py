"""Paths where many chains come to one node, and memory that doesn't grow with their number."""

from pyspark.sql import functions as F

from auditspark.operators import graph
from tests.test_graph import walk


def test_many_chains_to_one_node_are_dealt(spark, monkeypatch):
    """All ways of the 90 lead through node 1; one task used to join them all."""
    monkeypatch.setattr(graph, "TASK_ROWS", 5)
    files = []
    keep = graph.materialise

    def kept(df, name):
        table = keep(df, name)
        if name == "met":
            files.append([r["count"] for r in table.groupBy(F.input_file_name()).count().collect()])
        return table

    monkeypatch.setattr(graph, "materialise", kept)
    edges = [(0, None), (5, None), (1, 0), (1, 5), (2, 1), (2, 3), (3, 2)] + [(k, 1) for k in range(10, 100)]
    got = graph.paths(spark.createDataFrame(edges, "c long, p long"), "c", "p").collect()
    assert sorted(r["path"] for r in got) == walk(edges)[0]
    assert max(files[0]) < 90 and len(files[0]) > 3
