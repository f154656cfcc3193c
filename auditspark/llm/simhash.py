"""SimHash near-deduplication with BK-trees.

1. A text's fingerprint has a bit for each bit that is set in over half of its shingles' hashes. Equal fingerprints become
   one representative, by grouping.
2. Representatives are dealt to shards. Of the 64 bits, split into radius + 1 blocks, fingerprints that differ in no more than
   `radius` bits agree in one block at least (pigeonhole): a shard holds what agrees in a block's bits. A shard of more than
   SHARD members is dealt again, by blocks of the bits that are still free; after six times at most so few bits are
   free that no shard can have more. So every link lies inside a shard, and a shard's size is bounded whatever the data.
3. Each shard has a BK-tree: a node's children are keyed by their Hamming distance to it, so that a search follows only the
   edges within the radius of its own distance (triangle inequality). Search goes from a node to what it links with, and
   on from there; what is reached leaves the tree, and branches where nothing is left aren't followed. A shard thus returns
   what connects its members, one link for each at most, not all pairs.
4. Components of the links; the smallest doc_id names each.

A shard's tree is made in the task that holds the shard's members. It isn't sent through the driver, as a Spark broadcast of
all trees would carry every fingerprint there.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.llm.components import connected_components
from auditspark.llm.skew import join_unique
from auditspark.llm.workers import drop, spread
from auditspark.session import materialise, read_table, ship_package

BITS, RADIUS, WORDS, SEED = 64, 3, 3, 42
#: Members of a shard at most; rows that a task searches at once; searches between two removals from the trees.
SHARD, HELD, SLICE = 2**15, 2**16, 2**10
#: Shards to be dealt again (16 bytes each) up to which they are broadcast; more go through a shuffled join.
BROADCAST_ROWS = 500_000
#: Bytes of a text that are split into words at once.
PIECE = 2**20
SPACE = re.compile(rb"[\x20\x09-\x0d]")


def word_lists(text: str | None):
    """The text's words with A-Z in lower case, in lists of a bounded number of bytes."""
    raw, at = (text or "").encode().lower(), 0  # bytes: ASCII letters and ASCII white space only
    while at < len(raw):
        cut = SPACE.search(raw, at + PIECE)
        end = cut.start() if cut else len(raw)
        yield raw[at:end].split()
        at = end


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The SimHash of a text's shingles, repeats included; zero for a text without words."""
    import numpy as np
    import xxhash

    one = xxhash.xxh64_intdigest
    ones, n, tail = np.zeros(BITS, "i8"), 0, []

    def add(hashes: list) -> None:
        nonlocal ones, n
        bits = np.unpackbits(np.array(hashes, "<u8").view("u1").reshape(-1, 8), axis=1, bitorder="little")
        ones, n = ones + bits.sum(axis=0, dtype="i8"), n + len(hashes)

    for found in word_lists(text):
        tail += found
        if len(tail) >= words:
            line, ends = b" ".join(tail), np.cumsum(np.fromiter(map(len, tail), "i8", len(tail)) + 1)
            starts = np.concatenate([[0], ends[:-1]])
            for k in range(0, len(tail) - words + 1, PIECE // 64):
                stop = min(k + PIECE // 64, len(tail) - words + 1)
                add([one(line[a:b], SEED) for a, b in zip(starts[k:stop].tolist(), (ends[k + words - 1 : stop + words - 1] - 1).tolist(), strict=True)])
            tail = tail[-(words - 1) :] if words > 1 else []
    if not n and tail:
        add([one(b" ".join(tail), SEED)])
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, fp long), a row for each row."""

    def work(batches):
        import numpy as np
        import pyarrow as pa

        drop()
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], "u8").view("i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, fp long")


def signed(mask: int) -> int:
    return mask - 2**BITS if mask >> (BITS - 1) else mask


def finer(mask: int, radius: int) -> list[int]:
    """The mask with each of radius + 1 blocks of its free bits added."""
    free = [k for k in range(BITS) if not mask >> k & 1]
    cuts = [len(free) * k // (radius + 1) for k in range(radius + 2)]
    return [mask | sum(1 << k for k in free[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def shards(reps: DataFrame, radius: int = RADIUS, most: int = SHARD) -> DataFrame:
    """reps(rep, fp) -> (mask, value, rep, fp): each in its shards, whose members agree in the mask's bits; of at most
    `most` members, as long as that is more than 2 ** radius."""
    spark = reps.sparkSession

    def dealt(df: DataFrame, masks: list[int]) -> DataFrame:
        by = spark.createDataFrame([(signed(m), [signed(f) for f in finer(m, radius)]) for m in masks], "mask long, finer array<long>")
        return df.join(F.broadcast(by), "mask").select(F.explode("finer").alias("mask"), "rep", "fp").select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value"), "rep", "fp")

    masks, keyed, done = [0], reps.select(F.lit(0).cast("long").alias("mask"), "rep", "fp"), None
    while True:
        keyed = materialise(dealt(keyed, masks), "shards")
        full = materialise(keyed.groupBy("mask", "value").count().filter(F.col("count") > most).select("mask", "value"), "full-shards")
        masks = [r["mask"] % 2**BITS for r in full.select("mask").distinct().collect()]  # 4,096 at most, as the last level has so many
        masks = [m for m in masks if BITS - m.bit_count() > radius]
        if not masks:
            return keyed if done is None else done.unionByName(keyed)
        full = full.filter(F.col("mask").isin([signed(m) for m in masks]))
        hint = F.broadcast if full.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else lambda df: df
        own = keyed.join(hint(full), ["mask", "value"], "left_anti")
        done = own if done is None else done.unionByName(own)
        keyed = keyed.join(hint(full), ["mask", "value"], "left_semi").select("mask", "rep", "fp")


class Forest:
    """A BK-tree for each shard. x: fingerprints, shard: a number for each, in order; those of a shard are distinct."""

    def __init__(self, x, shard, radius: int = RADIUS):
        import numpy as np

        n = len(x)
        self.x, self.shard, self.radius = x, shard, radius
        self.parent, self.root, edge = np.full(n, -1), np.zeros(n, "i8"), np.zeros(n, "i8")
        starts = lambda key: np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        todo, key, levels = np.arange(n), shard.astype("i8"), []
        while len(todo):  # the first of each group is a node, the others hang below it, grouped by their distance
            at = starts(key)
            node = todo[at]
            if not levels:
                self.root = np.repeat(node, np.diff(np.r_[at, n]))
            levels.append(node)
            size = np.diff(np.r_[at, len(todo)])
            above, rest = np.repeat(node, size - 1), np.delete(todo, at)
            far = np.bitwise_count(x[rest] ^ x[above]).astype("i8")
            self.parent[rest], edge[rest] = above, far  # of the deepest group it gets to, at the end
            key = above * 128 + far
            order = np.argsort(key, kind="stable")
            todo, key = rest[order], key[order]
        self.children = np.argsort(self.parent * 128 + edge, kind="stable")
        self.keys = (self.parent * 128 + edge)[self.children]
        self.left = np.ones(n, "i8")  # what a node's branch still holds
        for node in levels[:0:-1]:
            np.add.at(self.left, self.parent[node], self.left[node])

    def remove(self, nodes) -> None:
        import numpy as np

        while len(nodes):
            np.subtract.at(self.left, nodes, 1)
            nodes = self.parent[nodes]
            nodes = nodes[nodes >= 0]

    def search(self, queries, gone):
        """(query, node): nodes within the radius that aren't gone."""
        import numpy as np

        q, node, found = queries, self.root[queries], []
        while len(q):
            far = np.bitwise_count(self.x[q] ^ self.x[node]).astype("i8")
            hit = (far <= self.radius) & ~gone[node]
            found.append((q[hit], node[hit]))
            lo, hi = (np.searchsorted(self.keys, node * 128 + np.clip(far + by, 0, 127), side) for by, side in ((-self.radius, "left"), (self.radius, "right")))
            many = hi - lo
            at = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())
            q, node = np.repeat(q, many), self.children[at]
            some = self.left[node] > 0
            q, node = q[some], node[some]
        return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (queries[:0], queries[:0])

    def connected(self):
        """For each fingerprint the number of the first one that links lead to, in its shard."""
        import numpy as np

        label = np.full(len(self.x), -1)
        rest = np.arange(len(self.x))
        while len(rest):
            own = self.shard[rest]
            edge = rest[np.r_[True, own[1:] != own[:-1]]]  # the first that is left of each shard
            label[edge] = edge
            self.remove(edge)
            while len(edge):
                reached = []
                for k in range(0, len(edge), SLICE):
                    q, node = self.search(edge[k : k + SLICE], label >= 0)
                    node, at = np.unique(node, return_index=True)
                    label[node] = label[q[at]]
                    self.remove(node)
                    reached.append(node)
                edge = np.concatenate(reached)
            rest = rest[label[rest] < 0]
        return label


def shard_links(keyed: DataFrame, radius: int = RADIUS) -> DataFrame:
    """keyed(mask, value, rep, fp) -> (a, b): links that connect whatever links connect inside a shard."""

    def work(batches):
        import numpy as np
        import pyarrow as pa

        drop()

        def links(table):
            mask, value, rep, fp = (c.to_numpy() for c in table.columns)
            shard = np.cumsum(np.r_[False, (mask[1:] != mask[:-1]) | (value[1:] != value[:-1])])
            label = Forest(fp.view("u8"), shard, radius).connected()
            keep = label != np.arange(len(label))
            return pa.RecordBatch.from_arrays([pa.array(rep[keep]), pa.array(rep[label[keep]])], names=["a", "b"])

        held = None
        for batch in batches:
            held = pa.table(batch) if held is None else pa.concat_tables([held, pa.table(batch)])
            if held.num_rows >= HELD:
                held = held.combine_chunks()
                mask, value = (held.column(k).to_numpy() for k in (0, 1))
                cut = int(np.flatnonzero((mask != mask[-1]) | (value != value[-1]))[-1]) + 1 if (mask[0], value[0]) != (mask[-1], value[-1]) else 0
                if cut:  # the last shard may go on in the next batch
                    yield links(held.slice(0, cut))
                    held = held.slice(cut)
        if held is not None and held.num_rows:
            yield links(held.combine_chunks())

    keys = ["mask", "value"]
    return keyed.select(*keys, "rep", "fp").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(work, "a long, b long")


def near_copies(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, fp long, component_id long), a row for each row.

    Fingerprints link if they differ in no more than `radius` bits; component_id is the smallest doc_id that links lead
    to, its own included.

    Defined results: null and empty texts and those without a word have fingerprint zero, which links like any other; a text
    of fewer words than a shingle has one, the whole; rows with a null doc_id have a null component_id and link nothing; rows
    that share an id are fingerprinted each, and an id with several fingerprints connects none of them (equal rows agree); an
    empty table gives an empty one; other columns are ignored.
    """
    ship_package(docs.sparkSession)
    prints = materialise(fingerprints(docs, words), "prints")
    reps = materialise(prints.filter("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "reps")
    # a fingerprint is its own node, as an id may have several
    links = shard_links(shards(reps.select(F.col("fp").alias("rep"), "fp"), radius), radius)
    joined = connected_components(links).select(F.col("node").alias("fp"), "component")
    of = materialise(reps.join(joined, "fp", "left").select("fp", "rep", "n", F.coalesce("component", "fp").alias("component")), "of")
    first = of.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("members"))
    named = materialise(join_unique(of, first.withColumnRenamed("members", "of_component"), ["component"], "of_component").select("fp", "component_id", "n"), "named")
    known = join_unique(prints.filter("doc_id IS NOT NULL"), named, ["fp"]).select("doc_id", "fp", "component_id")
    return known.unionByName(prints.filter("doc_id IS NULL").withColumn("component_id", F.lit(None).cast("long")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    hex_digits = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return near_copies(spread(read_table(spark, sf_dir, "documents"))).select("doc_id", hex_digits, "component_id")
