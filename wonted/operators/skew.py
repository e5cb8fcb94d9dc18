"""Finding keys that hold too many rows, and joins that spread such keys over many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wonted.config import DEFAULT_SKEW, SkewPolicy
from wonted.session import checkpointed


class HotKeys:
    """Keys too large for one task, per key column: a small DataFrame (key, n, lo, hi) or None.

    ``rows`` is the number of rows measured.
    """

    def __init__(self, frames: dict[str, DataFrame] | None = None, rows: int = 0):
        self._frames, self.rows = frames or {}, rows

    def get(self, column: str) -> DataFrame | None:
        return self._frames.get(column)


NONE_HOT = HotKeys()


def find_hot_keys(
    df: DataFrame,
    columns: list[str],
    time: str,
    row_id: str,
    policy: SkewPolicy = DEFAULT_SKEW,
) -> HotKeys:
    """Measure which values of each column hold more than ``policy.hot_rows`` rows of ``df``.

    A table smaller than that has no hot key and costs one count.  A very large table is measured on
    a hash sample of row ids: the list steers the physical plan only, results never depend on it.
    The list stays on the cluster; the driver sees one count per column.
    """
    rows = df.count()
    if rows <= policy.hot_rows:
        return HotKeys(rows=rows)
    modulus = max(1, rows // policy.sample_target)
    sample = df.filter(F.pmod(F.xxhash64(row_id), F.lit(modulus)) == 0) if modulus > 1 else df
    entries = F.array(
        *[F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("key")) for c in columns]
    )
    found = checkpointed(
        sample.select(F.explode(entries).alias("e"), F.col(time).cast("bigint").alias("t"))
        .filter("e.key IS NOT NULL")
        .groupBy("e.kind", "e.key")
        .agg(
            (F.count(F.lit(1)) * modulus).alias("n"),
            F.coalesce(F.min(F.nullif("t", F.lit(0))), F.lit(0)).alias("lo"),
            F.max("t").alias("hi"),
        )
        .filter(F.col("n") > max(policy.hot_rows, rows // policy.listed_keys))
    )
    kinds = {r["kind"] for r in found.select("kind").distinct().collect()}
    frames = {
        c: found.filter(F.col("kind") == c).select(F.col("key").cast(df.schema[c].dataType).alias("key"), "n", "lo", "hi")
        for c in columns
        if c in kinds
    }
    return HotKeys(frames, rows)


def salted_left_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    row_id: str,
    hot: DataFrame | None,
    policy: SkewPolicy = DEFAULT_SKEW,
) -> DataFrame:
    """Left join on one key, ``right`` unique per key.  Rows of hot keys get a salt from their row id
    and the single right row of such a key is repeated once per salt."""
    if hot is None:
        return left.join(right, key, "left")
    salts = F.ceil(F.col("n") / policy.chunk_rows).cast("int")  # all keys together: rows / chunk_rows copies
    h = F.broadcast(hot.select(F.col("key").alias(key), salts.alias("_salts")))
    many = F.coalesce("_salts", F.lit(1))
    salted = left.join(h, key, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(row_id), many.cast("bigint")).cast("int")
    )
    copies = right.join(h, key, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), many - 1))
    )
    return salted.drop("_salts").join(copies.drop("_salts"), [key, "_salt"], "left").drop("_salt")


def lookup_join(
    left: DataFrame, right: DataFrame, key: str, row_id: str, policy: SkewPolicy = DEFAULT_SKEW
) -> DataFrame:
    """Left join of wide rows with a table unique per key.  When the table is counted to be small it is
    broadcast and the wide rows stay where they are; else hot keys are measured and salted."""
    if right.limit(policy.broadcast_rows + 1).count() <= policy.broadcast_rows:
        return left.join(F.broadcast(right), key, "left")
    hot = find_hot_keys(left, [key], row_id, row_id, policy).get(key)
    return salted_left_join(left, right, key, row_id, hot, policy)


def chunk_columns(
    df: DataFrame, key: str, order: list[str], hot: DataFrame, policy: SkewPolicy
) -> DataFrame:
    """Add ``_chunk``, an array that cuts the ordered rows of each hot key into bounded runs.

    Level one cuts the time span of the key into equal blocks.  A block that still holds too many
    rows is cut at (time, ties, last tie / id_block), which is bounded for any data because the last
    tie is a unique row id.  Chunks compare like the rows in them; other keys get an empty chunk.
    """
    time = order[0]
    blocks = F.greatest(F.ceil(F.col("n") / policy.chunk_rows), F.lit(1))
    width = F.greatest(F.ceil((F.col("hi") - F.col("lo") + 1) / blocks), F.lit(1))
    h = F.broadcast(hot.select(F.col("key").alias(key), F.col("lo").alias("_lo"), width.alias("_w")))
    block = F.floor((F.col(time) - F.col("_lo")) / F.col("_w")).cast("bigint")
    df = df.join(h, key, "left").withColumn("_b", block)
    # fewer than half as many crowded blocks as chunks, and never more than the policy lists
    total = hot.agg(F.sum("n")).first()[0]
    crowded = checkpointed(
        df.filter("_b IS NOT NULL")
        .groupBy(key, "_b")
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > max(2 * policy.chunk_rows, total // policy.listed_keys))
        .select(key, "_b")
    )
    coarse = F.array("_b")
    if not crowded.isEmpty():
        df = df.join(F.broadcast(crowded.withColumn("_crowded", F.lit(True))), [key, "_b"], "left")
        last = F.floor(F.col(order[-1]) / policy.id_block).cast("bigint")
        fine = F.array("_b", *[F.col(c).cast("bigint") for c in order[:-1]], last)
        coarse = F.when(F.col("_crowded"), fine).otherwise(coarse)
        df = df.withColumn("_chunk", _when_hot(coarse)).drop("_crowded")
    else:
        df = df.withColumn("_chunk", _when_hot(coarse))
    return df.drop("_b", "_lo", "_w")


def _when_hot(chunk: Column) -> Column:
    return F.when(F.col("_b").isNotNull(), chunk).otherwise(F.array().cast("array<bigint>"))
