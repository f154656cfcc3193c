"""Connected components of a table of links, by alternating star contraction.

Each round hangs every node's larger neighbours on its smallest one (large star), then its smaller ones
(small star). Only a minimum by node and a join are needed, never a node's whole neighbourhood in one task;
the number of rounds grows with the logarithm of the number of nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditspark.llm.skew import ONE_TASK, join_unique
from auditspark.session import materialise


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    return join_unique(both, least, ["a"], total=2 * n).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    moved = join_unique(down, least, ["a"], total=n).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """links(a, b) -> (node, component): the smallest node reachable, for every node that has a link to
    another. Rows with a null or with equal ends link nothing; repeated links and an empty table are fine."""
    edges = materialise(links.select("a", "b").filter("a <> b").distinct(), "links")
    state = _state(edges)
    while state[0]:
        larger = _large_star(edges, state[0])
        if state[0] > ONE_TASK:  # else it is cheaper to make it again
            larger = materialise(larger, "links")
        edges = materialise(_small_star(larger, 2 * state[0]), "links")
        after = _state(edges)
        if after == state:
            break
        state = after
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
