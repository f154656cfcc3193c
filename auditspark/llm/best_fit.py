"""Best-fit decreasing packing of documents into token sequences.

Longer documents are cut to pieces first. Best-fit decreasing takes the pieces from long to short and puts
each into the open sequence that it fills best. Where it puts them depends on lengths alone, and there are
no more lengths than a sequence has tokens. So the plan is made on the histogram: open sequences are kept by
remaining capacity, as ranges of sequence numbers with the same room; a segment tree over the capacities
finds the tightest range in logarithmic time, and all pieces of a length that go to a range are placed
at once. The result is that of placing one piece after another. Then every piece, by its rank among those
of its length, looks up its place; pieces never pass through the driver, nor do all go to one task. A task that
cuts texts numbers its pieces of each length, so a rank is that number and a sum over the tasks before: counts
are shuffled, pieces and their ids aren't.
"""

from __future__ import annotations

import zlib

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditspark.llm.tokens import encoder, spread
from auditspark.session import materialise, read_table, ship_package

CAPACITY, END_ID = 1024, 2
#: Tasks whose sums (at most one for each length, so some 12 KB a task) are broadcast; those of more tasks are joined by a shuffle.
BROADCAST_TASKS = 2000


class OpenSequences:
    """Ranges of sequences by remaining capacity, under a segment tree that knows which capacities occur."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.some = [False] * (2 * self.leaves)
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(self.leaves)]

    def _mark(self, room: int) -> None:
        k = room + self.leaves
        self.some[k] = bool(self.ranges[room])
        while k > 1:
            k >>= 1
            self.some[k] = self.some[2 * k] or self.some[2 * k + 1]

    def add(self, room: int, first: int, n: int) -> None:
        if room > 0 and n > 0:
            self.ranges[room].append((first, n))
            self._mark(room)

    def take_tightest(self, length: int) -> tuple[int, int, int] | None:
        """Remove and return (room, first sequence, number) of the least room that is enough."""
        k = length + self.leaves
        while not self.some[k]:
            while k & 1:  # a right child: nothing to the right below this parent
                k >>= 1
                if k <= 1:
                    return None
            k += 1
        while k < self.leaves:
            k = 2 * k if self.some[2 * k] else 2 * k + 1
        room = k - self.leaves
        first, n = self.ranges[room].pop()
        self._mark(room)
        return room, first, n


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing of so many pieces of each length.

    Rows (length, rank, per, sequence, offset): of the pieces of that length those from this rank on go to the
    sequences from this one on, so many to each, from this offset on.
    """
    open_ones, rows, n_sequences = OpenSequences(capacity), [], 0
    for length in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens does not fit")
        rank, left = 0, histogram[length]
        while left:
            found = open_ones.take_tightest(length)
            if found:
                room, first, n = found
            else:
                room, first, n = capacity, n_sequences, -(-left // (capacity // length))
                n_sequences += n
            per = room // length
            full = min(n, left // per)
            if full:
                rows.append((length, rank, per, first, capacity - room))
                open_ones.add(room - per * length, first, full)
                rank, left, first, n = rank + full * per, left - full * per, first + full, n - full
            if left and n:  # fewer than fill one more
                rows.append((length, rank, left, first, capacity - room))
                open_ones.add(room - left * length, first, 1)
                first, n, left = first + 1, n - 1, 0
            open_ones.add(room, first, n)
    return rows


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece int, start, length, ids_crc32 long[, ids array<int>], task int, nth long): each text's ids and the
    end id, cut from the end into pieces of the capacity, so that the first one may be shorter. nth counts the
    earlier pieces of the same length in the task; write the rows before using it, as another run may deal them otherwise."""
    ship_package(docs.sparkSession)

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        words, task = encoder(tokenizer, False), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, "i8")
        for batch in batches:
            for part in spread(batch.column(1)):
                ids, ends = words.encode_ended(batch.column(1)[part], end_id)
                n = np.diff(ends, prepend=0)
                first = (n - 1) % capacity + 1
                pieces = (n - 1) // capacity + 1
                doc = np.repeat(np.arange(len(n)), pieces)
                piece = np.arange(len(doc)) - (np.cumsum(pieces) - pieces)[doc]
                length = np.where(piece == 0, first[doc], capacity)
                start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
                stops, data = np.cumsum(length), memoryview(ids.tobytes())
                crcs = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip((stops - length).tolist(), stops.tolist(), strict=True)]
                by_length = np.argsort(length, kind="stable")
                counts = np.bincount(length, minlength=capacity + 1)
                nth = np.empty(len(length), "i8")
                nth[by_length] = np.arange(len(length)) - np.repeat(np.cumsum(counts) - counts, counts)
                nth += seen[length]
                seen += counts
                columns = {"doc_id": batch.column(0)[part].take(pa.array(doc)), "piece": piece.astype("i4"), "start": start, "length": length, "ids_crc32": pa.array(crcs, pa.int64())}
                if keep_ids:
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(np.append(0, stops), pa.int32()), ids.astype("i4"))
                yield pa.RecordBatch.from_pydict(columns | {"task": np.full(len(length), task, "i4"), "nth": nth})

    columns = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids + ", task int, nth long"
    return docs.select("doc_id", "text").mapInArrow(cut, columns)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """docs(doc_id, text) -> cut_pieces() and sequence_id, offset (long): offsets of a sequence are gapless.

    Defined results: a null or empty text is the end id alone; rows that share an id (or are equal) are
    packed each; null ids are kept; an empty table gives an empty one; other columns are ignored.
    """
    pieces = materialise(cut_pieces(docs, tokenizer, capacity, end_id, keep_ids), "pieces")
    counts = materialise(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row for each length: at most `capacity`
    rows = plan(histogram, capacity)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    summed = counts.withColumn("_base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    bases = summed.groupBy("task").agg(F.map_from_entries(F.collect_list(F.struct("length", "_base"))).alias("_bases"))
    if counts.select("task").distinct().count() <= BROADCAST_TASKS:
        bases = F.broadcast(bases)
    ranked = pieces.join(bases, "task").withColumn("_rank", F.col("_bases")[F.col("length")] + F.col("nth"))
    # bounded by the capacity: ranges split at most a few times for each length
    by_length: dict[int, list[tuple]] = {}
    for length, *place in sorted(rows):
        by_length.setdefault(length, []).append(tuple(place))
    spark = docs.sparkSession
    table = spark.createDataFrame(list(by_length.items()), "length long, places array<struct<rank long, per long, first long, base long>>")
    own = F.element_at(F.filter("places", lambda p: p["rank"] <= F.col("_rank")), -1)
    far = F.col("_rank") - F.col("_own.rank")
    placed = ranked.join(F.broadcast(table), "length").withColumn("_own", own)
    kept = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]
    sequence, offset = F.col("_own.first") + F.floor(far / F.col("_own.per")), F.col("_own.base") + far % F.col("_own.per") * F.col("length")
    return placed.select(*kept, sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
