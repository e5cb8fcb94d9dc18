"""Small expressions and helpers shared by the operators."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wonted.session import checkpointed

#: The white space of the text rules, [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def partitions(df: DataFrame) -> int:
    """The session's number of shuffle partitions: set by whoever knows the size of the cluster and the data."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, other letters kept.  Plain ASCII takes the fast built-in; only the rest is translated."""
    plain = F.octet_length(c) == F.char_length(c)
    return F.when(plain, F.lower(c)).otherwise(F.translate(c, string.ascii_uppercase, string.ascii_lowercase))


def texts(docs: DataFrame, *others: str) -> DataFrame:
    """doc_id, twin, text and ``others``: null text is empty; (doc_id, twin) names a document up to repeated rows.

    twin is a hash of the text: rows that share a doc_id but not the text stay apart.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text, *others)
    return t.select("doc_id", F.xxhash64("text").alias("twin"), "text", *others)


def same_row(left: DataFrame, right: DataFrame) -> Column:
    """Join condition on (doc_id, twin); null ids meet each other, and no filter on them is inferred."""
    return left["doc_id"].eqNullSafe(right["doc_id"]) & left["twin"].eqNullSafe(right["twin"])


def saved(df: DataFrame) -> DataFrame:
    """Written to the shared checkpoint folder, lineage cut; survives lost executors."""
    return checkpointed(df)
