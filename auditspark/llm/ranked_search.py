"""Ranked lexical search, term at a time with limited accumulators.

1. Two passes over the texts' terms: one makes the index (each document's length and the frequencies of the items' terms, the
   only ones that can score), whose sums give the corpus statistics; one searches it.
2. The index is divided by documents. A task inverts a block of them and searches it for every item: terms are taken rarest
   first, each adding to an accumulator for each of its documents. A document that none of the terms so far holds can reach
   no more than the sum of the remaining terms' bounds (the largest that they add in the block). Once that is less than the
   kth best partial score (or the kth best score of the blocks before), no accumulators are made any more; those there are
   go on being updated with the remaining terms, exactly.
3. A task returns its k best documents of each item; the k best of those are the result. No posting is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditspark.llm.workers import drop, spread
from auditspark.session import materialise, read_table, ship_package

K = 10
#: (item, term) pairs that are broadcast at once, 100 MB at most with terms of up to 50 bytes; items with more take several passes.
QUERY_TERMS = 1_000_000
#: Postings of a block, and of an index batch; bytes of a text that are split into terms at once.
BLOCK, BATCH, PIECE = 1_000_000, 500_000, 2**20
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What stands between terms: ASCII but letters and digits.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
PLAIN = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256)).lower()


def terms_of(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, UPPER, UPPER.lower()), BETWEEN), lambda t: t != "")


def term_counts(text: str, wanted: dict[bytes, int]) -> tuple[int, dict[int, int]]:
    """The text's terms, and how often each of the wanted ones occurs, by number."""
    from collections import Counter

    raw, at, n, found = text.encode().translate(PLAIN), 0, 0, {}
    while at < len(raw):
        end = raw.find(b" ", at + PIECE)
        end = len(raw) if end < 0 else end
        words = raw[at:end].split()
        n, at = n + len(words), end
        own = Counter(words)
        for w in own.keys() & wanted.keys():
            found[wanted[w]] = found.get(wanted[w], 0) + own[w]
    return n, found


def index(docs: DataFrame, terms: list[str]) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n long, terms array<int>, tfs array<int>): every document that holds a term, with the
    numbers and the frequencies of those that are given."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)  # QUERY_TERMS at most

    def work(batches):
        import pyarrow as pa

        drop()
        wanted = {t.encode(): k for k, t in enumerate(shared.value)}
        for batch in batches:
            ids, ns, ends, found, tfs = [], [], [0], [], []

            def flush():
                offsets = pa.array(ends, pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (found, tfs)]
                return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n, own = term_counts(text.as_py() or "", wanted)
                if n:
                    ids.append(doc_id)
                    ns.append(n)
                    found.extend(own.keys())
                    tfs.extend(own.values())
                    ends.append(len(found))
                if len(found) > BATCH:
                    yield flush()
                    ids, ns, ends, found, tfs = [], [], [0], [], []
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, n long, terms array<int>, tfs array<int>")


class Block:
    """Documents with an inverted index. n: their lengths; row, term, tf: a posting each."""

    def __init__(self, ids, n, row, term, tf, corpus: tuple[int, int]):
        import numpy as np

        self.ids = ids
        order = np.lexsort((row, term))
        row, term, tf = row[order], term[order], tf[order].astype("i8")
        docs, length = corpus
        m = 25 + (75 * n.astype("i8") * docs) // length
        self.row, self.impact = row, (1_000_000_000 * tf) // (1000 * tf + 8 * m[row])
        held, at = np.unique(term, return_index=True)
        at = np.append(at, len(term))
        self.of = {int(t): slice(int(a), int(b)) for t, a, b in zip(held, at, at[1:], strict=False)}
        self.bound = {t: int(self.impact[s].max()) for t, s in self.of.items()}
        self.sums = np.zeros(len(ids), "i8")

    def best(self, query: list[tuple[int, int]], k: int, least: int = 0):
        """(ids, scores) of at least those of the k best documents that score `least` or more. query: (term, factor),
        rarest first."""
        import numpy as np

        terms = [(self.of[t], by, by * self.bound[t]) for t, by in query if by and t in self.of]
        sums, rest, kth, at = self.sums, sum(b for *_, b in terms), least, 0
        sums[:] = 0
        for own, by, bound in terms:  # accumulators are made
            if at:
                some = sums[sums > 0]
                if len(some) >= k:
                    kth = max(kth, int(np.partition(some, len(some) - k)[len(some) - k]))
            if rest < kth:
                break
            sums[self.row[own]] += by * self.impact[own]
            rest, at = rest - bound, at + 1
        rows = np.flatnonzero(sums)
        if at < len(terms):
            scores = sums[rows]
            for own, by, _ in terms[at:]:  # only those there are go on
                postings = self.row[own]
                place = np.searchsorted(postings, rows)
                place[place == len(postings)] = 0
                hit = postings[place] == rows
                scores[hit] += by * self.impact[own][place[hit]]
        else:
            scores = sums[rows]
        keep = scores >= max(kth, 1)
        return self.ids[rows[keep]], scores[keep]


def top(ids, scores, k: int):
    """The k best, ties by ascending id."""
    import numpy as np

    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def search_index(indexed: DataFrame, queries: list[tuple[int, list[tuple[int, int]]]], corpus: tuple[int, int], k: int) -> DataFrame:
    """(item_id, doc_id, score): of each partition the k best documents of each item, those without an id left out."""
    shared = indexed.sparkSession.sparkContext.broadcast(queries)

    def work(batches):
        import numpy as np
        import pyarrow as pa

        drop()
        none = np.empty(0, "i8")
        best = [(none, none)] * len(shared.value)
        held: list = []

        def search():
            ids, n, sizes, term, tf = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            block = Block(ids, n, np.repeat(np.arange(len(ids)), sizes), term, tf, corpus)
            for q, (_, query) in enumerate(shared.value):
                ids, scores = best[q]
                found = block.best(query, k, int(scores[-1]) if len(scores) == k else 0)
                best[q] = top(np.concatenate([ids, found[0]]), np.concatenate([scores, found[1]]), k)

        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            terms, tfs = batch.column(2), batch.column(3)
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), np.diff(terms.offsets.to_numpy()), terms.flatten().to_numpy(), tfs.flatten().to_numpy()))
            if sum(len(h[3]) for h in held) >= BLOCK:
                search()
        if held:
            search()
        of = [(item, i, s) for (item, _), (ids, scores) in zip(shared.value, best, strict=True) for i, s in zip(ids.tolist(), scores.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in of], pa.int64()) for c in range(3)], names=["item_id", "doc_id", "score"])

    return indexed.mapInArrow(work, "item_id long, doc_id long, score long")


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """docs(doc_id, text), items(item_id, text) -> (item_id, rank int, doc_id, score long): the k best documents of each item
    whose score is above 0, equal scores by ascending doc_id.

    Defined results: null and empty texts and those without a term are no documents, and find nothing as items; rows with a
    null doc_id count in the corpus and can't be ranked; rows that share a doc_id are ranked each (equal rows one after
    the other); items that share an id are one, of all their terms; items with a null id aren't searched; an empty table
    gives an empty result; other columns are ignored.
    """
    ship_package(docs.sparkSession)
    spark = docs.sparkSession
    wanted = items.filter("item_id IS NOT NULL").select("item_id", F.explode(terms_of(F.col("text"))).alias("term"))
    wanted = materialise(wanted.groupBy("item_id", "term").agg(F.count("*").alias("n")), "wanted")
    passes, dealt = 1, lambda n: F.pmod(F.xxhash64("item_id"), F.lit(n))
    while wanted.groupBy(dealt(passes).alias("p")).agg(F.count("*").alias("n"), F.count_distinct("item_id").alias("m")).filter((F.col("n") > QUERY_TERMS) & (F.col("m") > 1)).limit(1).count():
        passes *= 2
    found = None
    for p in range(passes):
        own = wanted.filter(dealt(passes) == p).collect()  # QUERY_TERMS at most, or one item's
        terms = sorted({r["term"] for r in own})
        indexed = materialise(index(docs, terms), "index")
        corpus = indexed.agg(F.count("*").alias("d"), F.sum("n").alias("l")).first()
        often = {r["t"]: r["df"] for r in indexed.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect()}
        number = {t: n for n, t in enumerate(terms)}
        queries: dict[int, list] = {}
        for r in own:
            if df := often.get(number[r["term"]]):
                queries.setdefault(r["item_id"], []).append((df, r["term"], number[r["term"]], r["n"] * weight(corpus["d"], df)))
        plan = [(item, [q[2:] for q in sorted(query)]) for item, query in sorted(queries.items())]
        part = search_index(indexed, plan, (corpus["d"], corpus["l"]), k) if plan else spark.createDataFrame([], "item_id long, doc_id long, score long")
        found = part if found is None else found.unionByName(part)
    order = [F.desc("score"), F.asc("doc_id")]
    # tasks return k rows for each item: they meet in groups first
    groups = math.isqrt(int(spark.conf.get("spark.sql.shuffle.partitions")))
    some = found.withColumn("of", F.pmod(F.xxhash64("doc_id"), F.lit(groups)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "of").orderBy(*order))).filter(F.col("rank") <= k)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spread(read_table(spark, sf_dir, "documents")), read_table(spark, sf_dir, "benchmark"))


_SPLIT = rf"list_filter(regexp_split_to_array(translate(text, '{UPPER}', '{UPPER.lower()}'), '{BETWEEN}'), lambda x: x <> '')"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_SPLIT} AS w FROM documents WHERE text IS NOT NULL),
docs AS (SELECT doc_id, r, len(w)::BIGINT AS n, w FROM d WHERE len(w) > 0),
c AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM docs),
q AS (SELECT item_id, t AS term, count(*)::BIGINT AS times FROM (SELECT item_id, unnest({_SPLIT}) AS t FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL) GROUP BY item_id, t),
p AS (SELECT r, t AS term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS t FROM docs) WHERE t IN (SELECT term FROM q) GROUP BY r, t),
f AS (SELECT term, CAST(floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM p, c GROUP BY term, big_n),
s AS (SELECT q.item_id, docs.r, docs.doc_id, sum(q.times * f.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (25 + (75 * docs.n * big_n) // big_l))))::BIGINT AS score
      FROM q JOIN f USING (term) JOIN p USING (term) JOIN docs USING (r), c WHERE docs.doc_id IS NOT NULL GROUP BY q.item_id, docs.r, docs.doc_id),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= {K}
"""
