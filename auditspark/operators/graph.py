"""Paths in nested definitions, where a node may have several parents, and cycles may occur."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditspark.session import materialise


#: Chains that one task joins; so much is sorted in it, however many there are.
TASK_ROWS = 200_000


def root_paths(edges: DataFrame, child: str, parent: str) -> tuple[DataFrame, DataFrame]:
    """edges(child, parent), a null parent for roots -> (paths, cycles), as the functions of these names give them."""
    return paths(edges, child, parent), cycles(edges, child, parent)


def paths(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """edges(child, parent), a null parent for roots -> (node, path array, depth): each way from a root down to a node, once;
    the path begins with the root and ends with the node. A way through a cycle is no path, so a node that hangs on cycles
    alone has none. Nor has one above which no root is. Repeated edges count once.

    Each node's chains upwards are doubled: one of 2 ** k steps goes on with the chains of the node it has come to, so
    that depth d takes about log2(d) joins. A chain that has come to a root is written once, and is read again only where
    another goes on with it. Joins have a task for TASK_ROWS chains; chains that have come to one node in larger numbers are
    dealt over several.
    """
    known = edges.select(F.col(child).alias("node"), F.col(parent).alias("top")).filter("node IS NOT NULL").distinct()
    # `path` holds the nodes from `node` up to the one before `top`, or up to the root, where `top` is null
    chains = materialise(known.select("node", "top", F.array("node").alias("path")), "chains")
    ended, open_ = chains.filter("top IS NULL"), chains.filter("top IS NOT NULL")
    few = edges.sparkSession.sparkContext.defaultParallelism
    while n := open_.count():
        tops = materialise(open_.groupBy("top").agg(F.ceil(F.count("*") / TASK_ROWS).cast("int").alias("seats")), "tops")
        above = ended.unionByName(open_).select(F.col("node").alias("top"), F.col("top").alias("beyond"), F.col("path").alias("rest")).join(tops, "top")
        above = above.withColumn("seat", F.explode_outer(F.sequence(F.lit(0), F.col("seats") - 1))).drop("seats")
        below = open_.join(F.broadcast(tops.filter("seats > 1")), "top", "left").withColumn("seat", F.pmod(F.xxhash64("node", "path"), F.coalesce("seats", F.lit(1))).cast("int")).drop("seats")
        if (tasks := -(-(n + ended.count()) // TASK_ROWS)) > few:
            below, above = below.repartition(tasks, "top", "seat"), above.repartition(tasks, "top", "seat")
        met = below.join(above, ["top", "seat"]).filter(~F.arrays_overlap("path", "rest"))
        met = materialise(met.select("node", F.col("beyond").alias("top"), F.concat("path", "rest").alias("path")), "met")
        ended, open_ = ended.unionByName(met.filter("top IS NULL")), met.filter("top IS NOT NULL")
    return ended.select("node", F.reverse("path").alias("path"), (F.size("path") - 1).alias("depth"))


#: Shrinking goes on while at least one node in so many goes.
WORTH = 20


def cycles(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """edges(child, parent) -> (node): the nodes from which parents lead back to them. Paths are not walked:
    no table has more rows than there are edges. An edge with a null leads nowhere.

    Rounds shrink the graph. Nodes without parents or without children are on no cycle and go. Of the nodes with one parent,
    those whose hash is above their neighbours' are passed by: their children are hung on that parent, so a chain takes
    rounds by the logarithm of its length. Where few nodes go, `_coloured` takes out strong components. Then the rounds are
    gone through backwards: a node passed by is on a cycle if a child is in its parent's component.
    """
    links = materialise(edges.select(F.col(child).alias("a"), F.col(parent).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL"), "links")
    labels = links.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    trail = []
    while True:
        nodes = materialise(_nodes(links, len(trail)), "nodes")
        n = nodes.agg(F.count("*").alias("all"), F.count_if("lives").alias("lives"), F.count_if(~F.col("lives") | F.col("alone")).alias("go"), F.count_if("loop").alias("loops")).first()
        if n["loops"]:
            trail.append((nodes.filter("loop").select("node"), None))
        if not n["lives"]:
            break
        links = links.filter("a <> b")
        if n["go"] * WORTH < n["all"]:
            found, links = _coloured(links)
            labels = labels.unionByName(found)
            continue
        stay = nodes.filter("lives AND onto IS NULL").select(F.col("node").alias("a"))
        kept = links.join(stay, "a", "left_semi").join(nodes.filter("lives").select(F.col("node").alias("b"), "onto"), "b")
        kept = materialise(kept.select("a", "b", "onto"), "kept")
        trail.append((None, kept))
        links = kept.select("a", F.coalesce("onto", "b").alias("b"))
    known = not labels.isEmpty()
    for loops, kept in reversed(trail):
        if loops is not None:
            more = loops.join(labels, "node", "left_anti").select("node", F.col("node").alias("component"))
        elif known:
            passed = kept.filter("onto IS NOT NULL").join(labels.withColumnRenamed("node", "a"), "a")
            more = passed.join(labels.withColumnRenamed("node", "onto"), ["onto", "component"]).select(F.col("b").alias("node"), "component").distinct()
        else:
            continue
        known, labels = True, labels.unionByName(materialise(more, "labels"))
    return labels.select("node")


def _nodes(links: DataFrame, salt: int) -> DataFrame:
    """links(a, its parent b) -> (node, loop, lives: has a parent and a child beside itself, alone: lives with one parent,
    onto: that parent, where the node is passed by). Of two neighbours one at most is."""
    h = lambda c: F.xxhash64(F.lit(salt), c)
    up = links.select(F.col("a").alias("node"), F.when(F.col("a") != F.col("b"), F.col("b")).alias("up"), F.lit(None).cast("long").alias("below"), (F.col("a") == F.col("b")).alias("loop"))
    down = links.filter("a <> b").select(F.col("b").alias("node"), F.lit(None).alias("up"), h("a").alias("below"), F.lit(False).alias("loop"))
    n = up.unionByName(down).groupBy("node").agg(F.min("up").alias("least"), F.max("up").alias("most"), F.max("below").alias("below"), F.bool_or("loop").alias("loop"))
    n = n.withColumn("lives", F.col("least").isNotNull() & F.col("below").isNotNull()).withColumn("alone", F.col("lives") & F.coalesce(F.col("least") == F.col("most"), F.lit(False)))
    return n.select("node", "loop", "lives", "alone", F.when(F.col("alone") & (h("node") > F.greatest("below", h("least"))), F.col("least")).alias("onto"))


def _coloured(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """links(a, its parent b) without loops -> ((node, component) of strong components of two nodes or more, the links that
    they leave). A node's colour is the largest node that leads up to it; the component of the node that gave a colour is what
    leads up to it inside the colour. Rounds: the longest of the shortest ways."""
    ends = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    colour = _spread(links, ends.select("node", F.col("node").alias("value")))
    inside = links.join(colour.select(F.col("node").alias("a"), F.col("value").alias("colour")), "a").join(colour.select(F.col("node").alias("b"), F.col("value").alias("colour")), ["b", "colour"])
    inside = materialise(inside.select("a", "b", "colour"), "inside")
    roots = colour.select("node", F.when(F.col("node") == F.col("value"), F.col("node")).alias("value"))
    own = materialise(_spread(inside.select(F.col("b").alias("a"), F.col("a").alias("b")), roots).filter("value IS NOT NULL"), "own")
    rest = materialise(links.join(own.select(F.col("node").alias("a")), "a", "left_anti").join(own.select(F.col("node").alias("b")), "b", "left_anti").select("a", "b"), "rest")
    mutual = inside.join(own.select(F.col("node").alias("a")), "a", "left_semi").join(own.select(F.col("node").alias("b")), "b", "left_semi")
    found = mutual.select(F.explode(F.array("a", "b")).alias("node"), F.col("colour").alias("component")).distinct()
    return materialise(found, "found"), rest


def _spread(links: DataFrame, start: DataFrame) -> DataFrame:
    """The largest value that reaches each node along the links, from a to b. start(node, value), a null for none."""
    state = materialise(start.select("node", "value", F.col("value").isNotNull().alias("new")), "spread")
    while not (new := state.filter("new")).isEmpty():
        sent = links.join(new.select(F.col("node").alias("a"), "value"), "a").select(F.col("b").alias("node"), "value", F.lit(None).alias("old"))
        best = state.select("node", "value", F.col("value").alias("old")).unionByName(sent).groupBy("node").agg(F.max("value").alias("value"), F.max("old").alias("old"))
        state = materialise(best.select("node", "value", (F.col("value").isNotNull() & ~F.col("value").eqNullSafe(F.col("old"))).alias("new")), "spread")
    return state.select("node", "value")
