"""Line deduplication, in DataFrame functions only.

Lines are exploded with their position, normalised and hashed; documents are counted per hash; the lines
of a repeated hash go from every document but the one with the largest id; what stays is put together
again by position. Only hashes, ids and positions are shuffled for the count; the text moves once, when
the dropped positions meet their document. A very common line is not gathered in one task: the hashes with more
than one in HOT_SHARE of all lines, which are HOT_SHARE at most, are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.session import materialise, read_table

WHITE = " \t\n\x0b\x0c\r"
HOT_SHARE = 1000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    """The line without white space at its ends and with A-Z (no other letters) in lower case."""
    bare = F.btrim(line, F.lit(WHITE))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, UPPER.lower()))


def repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Lines to drop: one row per (doc_id, digest of the text) with the positions."""
    lines = (
        docs.filter(F.col("doc_id").isNotNull())
        .select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode_outer(F.split("text", "\n")).alias("pos", "line"))
        .select("doc_id", "text_hash", "pos", line_key(F.col("line")).alias("key"))
        .filter(F.char_length("key") >= min_chars)
        .select("doc_id", "text_hash", "pos", F.unhex(F.md5("key")).alias("line_hash"))
    )
    # read twice below: written once (36 bytes a line) it spares the second normalising of all texts
    lines = materialise(lines, "lines")
    repeated = (
        lines.groupBy("line_hash")
        .agg(F.count_distinct("doc_id").alias("n_docs"), F.count("*").alias("n_lines"), F.max("doc_id").alias("keeper"))
        .filter(F.col("n_docs") >= min_docs)
        .select("line_hash", "keeper", (F.col("n_lines") * HOT_SHARE > lines.count()).alias("hot"))
    )
    repeated = materialise(repeated, "repeated")
    hot = F.broadcast(repeated.filter("hot").drop("hot"))
    others = lines.join(hot, "line_hash", "left_anti").join(repeated.filter("NOT hot").drop("hot"), "line_hash")
    return (
        lines.join(hot, "line_hash")
        .unionByName(others)
        .filter(F.col("doc_id") != F.col("keeper"))
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_set("pos").alias("dropped"))
    )


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """docs with three more columns: kept_text, n_lines (before dropping), n_dropped.

    Defined results: a null text counts as empty, an empty text is one empty line and kept_text is then
    empty; rows with a null doc_id are neither counted as documents nor changed; rows that share a doc_id
    count as one document, and each is cleaned; of equal lines within the kept document all stay; an empty
    table gives an empty table. Other columns pass through, but columns named like the three are replaced.
    """
    names = [c for c in docs.columns if c.lower() not in ("kept_text", "n_lines", "n_dropped")]
    rest = [c for c in names if c not in ("doc_id", "text")]
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    drops = repeated_lines(base, min_chars, min_docs)
    packed = docs.select(
        F.col("doc_id").alias("_id"),
        F.col("text").alias("_text"),
        F.coalesce("text", F.lit("")).alias("_filled"),
        F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in rest]).alias("_rest"),
    ).withColumn("_hash", F.xxhash64("_filled"))
    drops = drops.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), F.col("dropped").alias("_dropped"))
    joined = packed.join(drops, (F.col("_id") == F.col("_d")) & (F.col("_hash") == F.col("_h")), "left")
    cut = joined.withColumn("_lines", F.split("_filled", "\n")).withColumn(
        "_places", F.when(F.col("_dropped").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_dropped")))
    )
    kept = F.array_join(F.transform("_places", lambda i: F.get(F.col("_lines"), i)), "\n")
    out = {"doc_id": F.col("_id"), "text": F.col("_text")} | {c: F.col(f"_rest.`{c}`") for c in rest}
    return cut.select(
        *[out[c].alias(c) for c in names],
        F.when(F.col("_dropped").isNull(), F.col("_filled")).otherwise(kept).alias("kept_text"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.when(F.col("_dropped").isNull(), 0).otherwise(F.size("_dropped")).cast("long").alias("n_dropped"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE_SQL = """
WITH lines AS (
  SELECT doc_id, text, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos,
         unnest(string_split(coalesce(text, ''), chr(10))) AS line
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
repeated AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT k.*, (r.key IS NOT NULL AND k.doc_id <> r.keeper) AS gone
  FROM keyed k LEFT JOIN repeated r ON k.key = r.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
