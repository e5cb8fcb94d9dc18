"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is wanted target / source_size times: a whole part it always gets, and a fraction.
Two fractions a, b meet; at random one of them becomes 0 or 1 and the other takes the rest of the mass, with
chances that keep each expectation.  Fractions meet in the order of size, so mass moves between documents of
like size and the words taken stay close to the target.  A group leaves at most one fraction; the groups'
remainders meet again in larger groups, level by level, until one per source is left, which is rounded by itself.

Groups are (source, size class, salt): a hot source is split into as many salts as its rows need, and a group
never depends on more than ``group_rows`` rows on average.  Randomness is a hash of the row, the seed and the level, so
reruns agree whatever the partitioning.

Targets: ``share`` times all words, by weight, none above ``cap`` times its source's words; the excess goes to
the others by weight until none is above.  That is one level of water over all sources, found by a window over
the table of sources (one row each).

Results for odd input: null text has size 0; documents of size 0 take nothing; a null source is a source of its
own, last in order; null or repeated ids are rows like any other; an empty table gives no rows.  Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wonted.llm.common import DOCUMENT_COLUMNS, read, saved

WORD = r"[^\x20\x09-\x0D]+"
EPS = 1e-9
ROWS = "row long, doc_id long, size long, sid int, salt long, p double, source_size long, target double"


def row_mark():
    """A hash of id, source and text; null differs from empty, in each of them."""
    missing = [F.col(c).isNull() for c in ("doc_id", "source", "text")]
    marked = F.xxhash64("doc_id", "source", "text", *missing)  # a null by itself leaves the hash as it is
    return F.when(missing[0] | missing[1] | missing[2], marked).otherwise(F.xxhash64("doc_id", "source", "text"))


def sizes(docs: DataFrame) -> DataFrame:
    """row (a hash of id, source and text), doc_id, source, size in words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        row_mark().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
    )


def targets(sized: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, sid (order by code point, null last), rows, source_size, target."""
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    order = F.row_number().over(Window.orderBy(F.asc_nulls_last("source")))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") - 1) % len(weights) + 1)
    by = by.withColumn("sid", order).withColumn("weight", weight).withColumn("most", cap * F.col("source_size"))
    fullest = Window.orderBy(F.col("most") / F.col("weight"), "sid")
    before, onward = fullest.rowsBetween(Window.unboundedPreceding, -1), fullest.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy()) * share
    left = total - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    by = by.withColumn("level", left / F.sum("weight").over(onward))
    # sources fill up in order of most / weight; the level is that of the first one that doesn't
    water = F.max(F.when(F.col("most") > F.col("weight") * F.col("level"), F.col("level"))).over(Window.partitionBy())
    by = by.withColumn("water", water)
    target = F.when(F.col("water").isNull(), F.col("most")).otherwise(F.least("most", F.col("weight") * F.col("water")))
    return by.select("source", "sid", "rows", "source_size", target.alias("target"))


def _uniform(rows: np.ndarray, seed: int, level: int) -> np.ndarray:
    """One number in [0, 1) per row, a mixed hash of the row, the seed and the level."""
    x = rows.astype(np.int64).view(np.uint64) + np.uint64((seed * 1_000_003 + level * 7919 + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / 2.0**53


def pivot(p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Fractions rounded in their order; at most one stays between 0 and 1.  The sum is kept."""
    out, held, a = p.copy(), -1, 0.0
    for j, b in enumerate(p):
        if b <= EPS or b >= 1 - EPS:
            out[j] = round(b)
            continue
        if held < 0:
            held, a = j, b
            continue
        s = a + b
        if s < 1 - EPS:  # one of the two goes to 0
            gone, stays = (held, j) if u[j] * s < b else (j, held)
            out[gone], held, a = 0.0, stays, s
        else:  # one of the two goes to 1
            gone, stays = (held, j) if u[j] * (2 - s) < 1 - b else (j, held)
            out[gone], held, a = 1.0, stays, s - 1
        out[held] = a
        if a <= EPS:
            out[held], held = 0.0, -1
    return out


def _round_level(rows: DataFrame, groups: list, seed: int, level: int, last: bool) -> DataFrame:
    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "doc_id", "row"], kind="stable", na_position="first")
        u = _uniform(pdf["row"].to_numpy(), seed, level)
        p = pivot(pdf["p"].to_numpy(), u)
        if last:
            p = np.where((p > EPS) & (p < 1 - EPS), (u < p).astype(float), p)
        return pdf.assign(p=p)[[x.split()[0] for x in ROWS.split(", ")]]

    return rows.groupBy(*groups).applyInPandas(step, ROWS)


def fraction_left(p: Column) -> Column:
    return (p > EPS) & (p < 1 - EPS)


def copies(sized: DataFrame, plan: DataFrame, seed: int = 17, group_rows: int = 20_000, fan_in: int = 256) -> DataFrame:
    """row, doc_id, size, sid, source_size, target, copies: how often the mix takes each row of ``sizes``."""
    want = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = saved(plan.withColumn("want", want).withColumn("salts", F.ceil(F.col("rows") / group_rows)))
    widest = plan.agg(F.max("salts")).first()[0]  # one number
    if widest is None:
        return sized.select("row", "doc_id", "size", *[F.lit(0).alias(c) for c in ("sid", "source_size", "target", "copies")])
    p = plan.withColumnRenamed("source", "source_")
    joined = sized.join(p, sized["source"].eqNullSafe(p["source_"]))
    whole = F.floor(F.col("want") + EPS)
    rows = joined.select(
        "row", "doc_id", "size", "sid",
        F.pmod(F.xxhash64("row", F.lit(seed)), F.col("salts")).alias("salt"),
        F.when(F.col("size") > 0, F.greatest(F.col("want") - whole, F.lit(0.0))).otherwise(0.0).alias("p"),
        "source_size", "target",
    )
    size_class = F.floor(F.log2(F.col("size") + F.lit(1.0))).alias("class")
    done, level = [], 0
    step = saved(_round_level(rows, ["sid", "salt", size_class], seed, level, last=False))
    while True:
        open_ = fraction_left(F.col("p"))
        done.append(step.filter(~open_))
        level, last = level + 1, widest <= 1
        widest = -(-widest // fan_in)
        groups = ["sid", "salt"] if not last else ["sid"]
        merged = step.filter(open_).withColumn("salt", F.floor(F.col("salt") / fan_in))
        step = saved(_round_level(merged, groups, seed, level, last))
        if last:
            done.append(step)
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    want = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.when(F.col("size") > 0, F.floor(want + EPS)).otherwise(0)
    return out.select("row", "doc_id", "size", "sid", "source_size", "target", (whole + F.round("p")).cast("int").alias("copies"))


def query(spark, folder: str) -> DataFrame:
    sized = saved(sizes(read(spark, folder, "documents")))  # the texts are read once
    taken = copies(sized, targets(sized))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies")


def stage(spark, docs: DataFrame, folder: str) -> DataFrame:
    """Documents as often as the mix takes them (0, 1 or 2 rows each)."""
    sized = saved(sizes(docs))
    taken = copies(sized, targets(sized)).groupBy("row", F.col("doc_id").alias("id")).agg(F.sum("copies").cast("int").alias("times"))
    rows = docs.select(*DOCUMENT_COLUMNS).withColumn("row", row_mark())
    same = (rows["row"] == taken["row"]) & rows["doc_id"].cast("long").eqNullSafe(taken["id"])
    once = rows.dropDuplicates(["row", "doc_id"]).join(taken.filter("times > 0"), same)
    return once.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*DOCUMENT_COLUMNS)
