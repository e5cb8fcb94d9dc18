"""Gapless numbers in a global order, without sorting in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wonted.session import checkpointed


def numbered(rows: DataFrame, order: list[str], name: str, start: int = 1) -> DataFrame:
    """``rows`` with numbers from ``start`` in the order of columns or SQL texts that tell all rows apart.

    Rows are range-partitioned in that order; the sizes of the partitions, one row each, are summed up, and a row's
    number is its partition's start plus its place in it.
    """
    keyed = rows.selectExpr("*", *[f"{o} AS _o{i}" for i, o in enumerate(order)])
    keys = [f"_o{i}" for i in range(len(order))]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpointed(keyed.repartitionByRange(n, *keys).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    found = ranged.withColumn("_place", place).join(F.broadcast(starts), "_part")  # one row per partition
    return found.withColumn(name, F.col("_start") + F.col("_place") + F.lit(start - 1).cast("bigint")).drop(*keys, "_part", "_start", "_place")


#: Sent folders first, so that what one wrote is known when the answers come; then folder by folder in order of uid.
ARRIVAL = ["folder_role <> 'sent'", "account_id", "folder", "generation", "uid"]


def arrival_numbers(landed: DataFrame, start: int = 1) -> DataFrame:
    """Landed rows of one run with msg_id in order of arrival."""
    return numbered(landed.drop("msg_id"), ARRIVAL, "msg_id", start)
