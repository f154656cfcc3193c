"""Record logs: merging retries, fingerprints, unions with a ledger of exclusions, byte-capped batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditspark.operators.ranges import last_before, numbered
from auditspark.session import materialise, ship_package


def compact_attempts(log: DataFrame, key: str, ordinal: str, ok: Column, payload: Sequence[str]) -> DataFrame:
    """(key, _ok, _p, _n, _first): how often each outcome occurred for a key, and where first. Compacted logs can be put
    together and compacted again (recompact), which is what an incremental merge keeps as its state."""
    rows = log.select(key, ok.alias("_ok"), F.struct(*payload).alias("_p"), F.col(ordinal).alias("_first"), F.lit(1).cast("long").alias("_n"))
    return recompact(rows, key)


def recompact(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key, "_ok", "_p").agg(F.sum("_n").alias("_n"), F.min("_first").alias("_first"))


def resolve_attempts(compacted: DataFrame, key: str, ordinal: str) -> DataFrame:
    """One record per key: a success beats a failure, else the first stays.

    (key, the kept record's ordinal, kept_ok, the payload's columns, attempts, failures, duplicates, disagreements:
    successes whose payload differs from a kept success). Keys may be null. Sums and a minimum only, so a hot key's
    rows are combined before the shuffle.
    """
    best = F.min(F.struct((~F.col("_ok")).alias("bad"), "_first", "_p", "_n"))
    kept = compacted.groupBy(key).agg(best.alias("_kept"), F.sum("_n").alias("attempts"), F.coalesce(F.sum(F.when(~F.col("_ok"), F.col("_n"))), F.lit(0)).alias("failures"))
    return kept.select(
        key,
        F.col("_kept._first").alias(ordinal),
        (~F.col("_kept.bad")).alias("kept_ok"),
        "_kept._p.*",
        "attempts",
        "failures",
        (F.col("attempts") - 1).alias("duplicates"),
        F.when(F.col("_kept.bad"), 0).otherwise(F.col("attempts") - F.col("failures") - F.col("_kept._n")).cast("long").alias("disagreements"),
    )


def merge_attempts(log: DataFrame, key: str, ordinal: str, ok: Column, payload: Sequence[str]) -> DataFrame:
    """One record per key of an append-only log; see resolve_attempts."""
    return resolve_attempts(compact_attempts(log, key, ordinal, ok, payload), key, ordinal)


def fingerprint(items: Column) -> Column:
    """An order-insensitive hash of an array of structs."""
    return F.sha2(F.array_join(F.array_sort(F.transform(items, lambda i: F.to_json(i))), "\n"), 256)


def union_with_ledger(sources: dict[str, tuple[DataFrame, Column]]) -> tuple[DataFrame, DataFrame]:
    """(rows, ledger): the sources' rows put together with a `source` column where their reason is null; the
    ledger counts what was left out by source and reason."""
    kept, left = None, None
    for name, (df, reason) in sources.items():
        tagged = df.withColumn("source", F.lit(name)).withColumn("reason", reason)
        good, bad = tagged.filter("reason IS NULL").drop("reason"), tagged.filter("reason IS NOT NULL").groupBy("source", "reason").agg(F.count("*").alias("n"))
        kept = good if kept is None else kept.unionByName(good, allowMissingColumns=True)
        left = bad if left is None else left.unionByName(bad)
    return kept, left


def pending(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is not recorded yet."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def completeness(recorded: DataFrame, planned: DataFrame, group: str, key: str) -> DataFrame:
    """Recorded against planned series per group: complete, in flight or not started."""
    a = planned.groupBy(group).agg(F.count_distinct(key).alias("planned"))
    b = recorded.groupBy(group).agg(F.count_distinct(key).alias("recorded"))
    j = a.join(b, group, "full_outer").select(group, F.coalesce("planned", F.lit(0)).alias("planned"), F.coalesce("recorded", F.lit(0)).alias("recorded"))
    return j.withColumn("state", F.when(F.col("recorded") == 0, "not started").when(F.col("recorded") < F.col("planned"), "in flight").otherwise("complete"))


#: Consecutive rows that one task walks through.
BLOCK = 100_000


def byte_batches(work: DataFrame, order: Sequence[Column], size: str, key: str, max_bytes: int, max_count: int, block: int = BLOCK) -> DataFrame:
    """Next-fit batches over one global order, capped by bytes and by count: (key, size long, batch long from 0).

    A batch is closed when the next item would break a cap; an item over the cap is a batch alone; a null size counts as
    0. The result doesn't depend on partitions: sums before each row say where a batch that starts there would end (its jump);
    in blocks of consecutive rows jumps are followed to where they leave the block; among those exits, a few for each
    block, pointers are doubled until all that is reached from the first row is marked; a block then marks its starts.
    """
    ship_package(work.sparkSession)
    rows = work.select(F.col(key).alias("key"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("size"), *[c.alias(f"_o{k}") for k, c in enumerate(order)])
    placed = materialise(numbered(rows, [F.asc(f"_o{k}") for k in range(len(order))], "n", ["size"]).select("key", "size", (F.col("n") - 1).alias("n"), "before_size"), "placed")
    end = placed.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("value"))
    points = placed.select(F.col("before_size").alias("value"), "n").unionByName(end.select("value", "n"))
    reached = last_before(points, placed.select((F.col("before_size") + F.lit(max_bytes)).alias("value"), F.col("n").alias("id")))
    to = F.least(F.greatest("n", F.col("id") + 1), F.col("id") + F.lit(max_count))
    jumps = materialise(reached.select(F.col("id").alias("n"), to.alias("to"), F.floor(F.col("id") / block).cast("long").alias("block")), "jumps")

    def leave(table):
        import numpy as np
        import pyarrow as pa

        table = table.sort_by("n")
        n, to = table.column("n").to_numpy(), table.column("to").to_numpy()
        out, first, past = to.copy(), int(n[0]), int(n[-1]) + 1
        for k in np.flatnonzero(to < past)[::-1].tolist():
            out[k] = out[to[k] - first]
        return pa.table({"n": n, "exit": out})

    exits = materialise(jumps.groupBy("block").applyInArrow(leave, "n long, exit long"), "exits")
    last = end.first()["n"]
    spark = work.sparkSession
    marked = spark.createDataFrame([(0,)], "n long")
    entries = exits.select(F.col("exit").alias("n")).unionByName(marked).distinct()
    far = materialise(exits.join(entries, "n", "left_semi").withColumnRenamed("exit", "to"), "doubled")
    while True:  # `marked` holds the first 2 ** k entries of the path, `far` goes 2 ** k entries on
        more = materialise(marked.join(far, "n").select(F.col("to").alias("n")).filter(F.col("n") < last), "marked")
        if more.isEmpty():
            break
        marked = materialise(marked.unionByName(more), "marked")
        far = materialise(far.join(far.select(F.col("n").alias("to"), F.col("to").alias("next")), "to").select("n", F.col("next").alias("to")), "doubled")

    def starts(table):
        import numpy as np
        import pyarrow as pa

        table = table.sort_by("n")
        n, to, entry = (table.column(c).to_numpy() for c in ("n", "to", "entry"))
        first, past, begins = int(n[0]), int(n[-1]) + 1, np.zeros(len(n), bool)
        for at in n[entry > 0].tolist():  # one at most, as the path enters a block once
            while at < past:
                begins[at - first] = True
                at = int(to[at - first])
        return pa.table({"block": table.column("block"), "n": n, "begun": np.cumsum(begins)})

    flagged = jumps.join(marked.withColumn("entry", F.lit(1)), "n", "left").fillna(0, ["entry"])
    begun = materialise(flagged.groupBy("block").applyInArrow(starts, "block long, n long, begun long"), "begun")
    per = begun.groupBy("block").agg(F.max("begun").alias("own"))
    before = per.select("block", F.coalesce(F.sum("own").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row for each block
    number = begun.join(before, "block").select("n", (F.col("begun") + F.col("before") - 1).alias("batch"))
    return placed.join(number, "n").select("key", "size", "batch")
