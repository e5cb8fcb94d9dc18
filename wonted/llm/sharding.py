"""Contiguous shards of near equal bytes from global prefix sums.

Rows are range-partitioned in their order; every partition contributes one total, the totals are summed up in
order (one row per partition, never per document), and a row's global byte offset is its partition's start plus
the running sum within the partition.  Shards are cut at equal multiples of total / shards: a row belongs to the
shard that holds its middle byte, so a shard misses its target by less than the two rows at its ends.

Only (id, size, checksum) move; the text stays where it was read.

Order: doc_id (nulls first), then checksum, then size; rows equal in all three are interchangeable.  Null text
has size 1 (the separator).  An empty table gives no rows.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wonted.llm.common import partitions, saved

ORDER = ("doc_id", "text_crc32", "size")


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus one), text_crc32."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )


def byte_shards(sized: DataFrame, shards: int = 16, parts: int | None = None) -> DataFrame:
    """Adds shard (0 to shards - 1) and slot (gapless from 0 in each shard) to rows of ``sizes``."""
    n = parts or partitions(sized)
    ranged = saved(sized.repartitionByRange(n, *ORDER).withColumn("part", F.spark_partition_id()))

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    starts = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("start"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"),
    )
    whole = totals.agg(F.sum("bytes").alias("total"))

    upto = Window.partitionBy("part").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        ranged.withColumn("upto", F.sum("size").over(upto))
        .withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy(*ORDER)) - 1)
        .join(F.broadcast(starts), "part")  # as many rows as partitions
        .join(F.broadcast(whole))  # one row
        .withColumn("row", F.col("first") + F.col("at"))
        .withColumn("shard", F.expr(f"cast((2 * (start + upto) - size) * {shards} div (2 * total) as int)"))
    )
    firsts = placed.groupBy("shard").agg(F.min("row").alias("opening"))  # one row per shard
    return placed.join(F.broadcast(firsts), "shard").select(*ORDER, "shard", (F.col("row") - F.col("opening")).alias("slot"))


def query(spark, folder: str) -> DataFrame:
    from wonted.llm.common import read

    placed = byte_shards(sizes(read(spark, folder, "documents")))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


#: The checksum folds the bytes with the 256-entry table, which is computed from the polynomial.
ORACLE = """
WITH RECURSIVE steps AS (
  SELECT i, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) r(i)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8
), tab AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
d AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, hex(encode(coalesce(text, ''))) AS x FROM documents),
sized AS (
  SELECT doc_id, size, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(0, size - 1),
      lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[CAST(xor(c & 255, b) AS INT) + 1]))) AS text_crc32
  FROM d, tab
), placed AS (
  SELECT *, CAST((2 * CAST(sum(size) OVER w AS HUGEINT) - size) * 16 // (2 * sum(size) OVER ()) AS INT) AS shard
  FROM sized WINDOW w AS (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING)
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, CAST(NULL AS INT) AS grown_shard
FROM placed"""
