"""Benchmark decontamination, in DataFrame functions only.

Containment MinHash with sketches whose length depends on the item's size class. Items are partitioned by
the power of two of their shingle count; each keeps the m smallest shingle hashes, where m is one more than
the shingles that an item of the class's upper size may miss at the wanted containment. An item contained
in a document to that degree must then share a sketch hash with it (it can't miss all m), so short items
are found inside documents of any length and none is lost. What shares a hash is a candidate; candidates are
verified by exact shingle containment. An item of fewer words than a shingle has one, of all its words; documents
are then searched for runs of that length too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.session import materialise, read_table

#: Candidate documents, or hashes of sketches (16 bytes each), up to which they are broadcast; more go through a shuffled join.
BROADCAST_ROWS = 500_000


def word_hashes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, w): the hashes of the text's lower-case words of letters and digits; null where the text is null."""
    tokens = F.filter(F.split(F.lower(F.col(text_col)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return df.select(F.col(id_col).alias("id"), F.transform(tokens, lambda w: F.xxhash64(w)).alias("w"))


def runs(words: int) -> Column:
    """The 64-bit hashes of the runs of so many words of w; null if there are fewer."""
    run = lambda i: F.xxhash64(*[F.get(F.col("w"), i + k) for k in range(words)])
    return F.when(F.size("w") >= words, F.transform(F.sequence(F.lit(0), F.size("w") - words), run))


def shingle_hashes(df: DataFrame, id_col: str, text_col: str, lengths: list[int]) -> DataFrame:
    """(id, shingles): the hashes of the text's runs of so many words, for each of the lengths; null if it has none.

    Explode them with explode_outer: explode adds a filter on the array's size, which is pushed below the
    projections and computes every word's hash again for each element.
    """
    hashed = word_hashes(df, id_col, text_col)
    if len(lengths) == 1:
        return hashed.select("id", runs(lengths[0]).alias("shingles"))
    return hashed.select("id", F.flatten(F.array_compact(F.array(*[runs(n) for n in lengths]))).alias("shingles"))


def item_sketches(items: DataFrame, words: int = 5, containment: float = 0.8, least_words: int = 1) -> DataFrame:
    """(item_id, n_words, n_shingles, size_class, sketch, shingles) of each item with at least so many words. n_words: the words of a
    shingle, all the item's if it has fewer."""
    own = F.coalesce(runs(words), *[F.when(F.size("w") == n, runs(n)) for n in range(words - 1, 0, -1)])
    sized = (
        word_hashes(items, "item_id", "text")
        .filter(F.size("w") >= least_words)
        .select(F.col("id").alias("item_id"), F.least(F.size("w"), F.lit(words)).alias("n_words"), F.array_sort(F.array_distinct(own)).alias("shingles"))
        .filter(F.col("shingles").isNotNull())
        .withColumn("n_shingles", F.size("shingles"))
    )
    size_class = F.floor(F.log2(F.col("n_shingles").cast("double")))
    upper = F.pow(F.lit(2.0), F.col("size_class") + 1) - 1
    return (
        sized.withColumn("size_class", size_class)
        .withColumn("length", F.least(F.col("n_shingles"), (F.floor(upper * F.lit(1 - containment) + 1e-9) + 1).cast("int")))
        .select("item_id", "n_words", "n_shingles", "size_class", F.slice("shingles", F.lit(1), F.col("length")).alias("sketch"), "shingles")
    )


def contaminated(docs: DataFrame, items: DataFrame, words: int = 5, containment: float = 0.8, least_words: int = 1) -> DataFrame:
    """Pairs of a document and an item of which it holds at least so large a share of the shingles. Items of fewer words
    than least_words (1: none) are left out: an item of one word is found in every document that has the word.

    docs(doc_id, text), items(item_id, text) -> (doc_id, item_id, n_item_shingles long, n_found long,
    containment double). Other columns are ignored.

    Defined results: an item of fewer words than a shingle is found where all its words stand in a row; null or
    empty texts and texts without a word match nothing; rows with a null id are never reported; rows that share an id count as one document (item); equal items are each
    reported; an empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    items = items.select("item_id", "text").filter(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    sketches = materialise(item_sketches(items, words, containment, least_words), "sketches")
    lengths = sorted(r["n_words"] for r in sketches.select("n_words").distinct().collect()) or [words]  # `words` numbers at most
    keys = materialise(sketches.select(F.explode("sketch").alias("shingle")).distinct(), "sketch-hashes")
    few = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    probes = shingle_hashes(docs, "doc_id", "text", lengths).select(F.col("id").alias("doc_id"), F.explode_outer("shingles").alias("shingle"))
    candidates = materialise(probes.join(F.broadcast(keys) if few else keys, "shingle", "left_semi").select("doc_id").distinct(), "candidates")
    small = candidates.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    suspects = docs.join(F.broadcast(candidates) if small else candidates, "doc_id", "left_semi")
    found = (
        shingle_hashes(suspects, "doc_id", "text", lengths)
        .select(F.col("id").alias("doc_id"), F.explode_outer(F.array_distinct("shingles")).alias("shingle"))
        .join(sketches.select("item_id", F.explode("shingles").alias("shingle")).distinct(), "shingle")
        .groupBy("doc_id", "item_id")
        .agg(F.count_distinct("shingle").alias("n_found"))
    )
    sizes = sketches.groupBy("item_id").agg(F.size(F.array_distinct(F.flatten(F.collect_list("shingles")))).cast("long").alias("n_item_shingles"))
    share = F.col("n_found") / F.col("n_item_shingles")
    return (
        found.join(sizes, "item_id")
        .filter(F.col("n_found") >= F.ceil(F.col("n_item_shingles") * F.lit(containment) - 1e-9))
        .select("doc_id", "item_id", "n_item_shingles", "n_found", share.alias("containment"))
    )


def decontaminate(docs: DataFrame, items: DataFrame, words: int = 5, containment: float = 0.8, least_words: int = 1) -> DataFrame:
    """docs without the documents that contain an item; rows with a null doc_id stay. For least_words see contaminated."""
    bad = contaminated(docs, items, words, containment, least_words).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
            FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
iw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
       FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
isx AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - least(5, len(w)) + 2), lambda i: array_to_string(w[i:i + least(5, len(w)) - 1], ' '))) AS s
        FROM iw WHERE len(w) >= 1),
k AS (SELECT DISTINCT least(5, len(w)) AS k FROM iw WHERE len(w) >= 1),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s
       FROM dw, k WHERE len(w) >= k),
n AS (SELECT item_id, count(*) AS n_item_shingles FROM isx GROUP BY item_id),
f AS (SELECT doc_id, item_id, count(*) AS n_found FROM ds JOIN isx USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_item_shingles, n_found, n_found / n_item_shingles AS containment
FROM f JOIN n USING (item_id) WHERE n_found >= 0.8 * n_item_shingles
"""
