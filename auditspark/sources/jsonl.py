"""Append-only JSONL logs of nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt"


def with_corrupt(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])


def read_lines(spark: SparkSession, path: str, schema: T.StructType, required: str) -> DataFrame:
    """A row for each non-blank line: the record's columns, the line in _corrupt where it can't be parsed, `problem`
    (unparsable, wrong shape where the required member is missing, else null), and file and line order as `ordinal`:
    (file, start of the split, place in it).

    A half-written last line is such a line; it is counted, and no line stops the read.
    """
    raw = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place")).alias("ordinal"))
    full = with_corrupt(schema)
    parsed = raw.filter(F.trim("value") != "").select("ordinal", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("r"))
    problem = F.when(F.col(f"r.{CORRUPT}").isNotNull(), "unparsable").when(F.col(f"r.{required}").isNull(), "wrong shape")
    return parsed.select("r.*", "ordinal", problem.alias("problem"))


def line_counts(lines: DataFrame) -> DataFrame:
    return lines.agg(F.count("*").alias("lines_seen"), F.count_if(F.col("problem") == "unparsable").alias("unparsable"), F.count_if(F.col("problem") == "wrong shape").alias("wrong_shape"))


def records(lines: DataFrame) -> DataFrame:
    return lines.filter("problem IS NULL").drop("problem", CORRUPT)
