"""Vector tables cut into blocks: every block of queries meets the blocks of vectors it has to."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usable(table: DataFrame, zero: bool) -> DataFrame:
    """vec_id, v (the embedding as stored) of the rows that take part, one per id.

    Left out: null ids, null vectors, vectors with null or non-finite components and, unless ``zero``, zero vectors.
    Rows that share an id count once, with the largest vector in array order.
    """
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")).filter("vec_id is not null and v is not null")
    rows = rows.filter("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    if not zero:
        rows = rows.filter("exists(v, x -> x <> 0)")
    return rows.groupBy("vec_id").agg(F.max("v").alias("v"))


def cells(rows: DataFrame, keys: list[str], parts, name: str) -> DataFrame:
    """One row per key and part, with the (vec_id, v) of its rows in an array; ``parts`` bounds a cell's size."""
    part = F.pmod(F.xxhash64("vec_id"), parts)
    return rows.groupBy(*keys, part.alias(f"{name}_part")).agg(F.collect_list(F.struct("vec_id", "v")).alias(name))


def unpacked(cell: pa.Scalar, width: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and a matrix of doubles with ``width`` columns; shorter vectors are filled with zeros."""
    return cell.values.field("vec_id").to_numpy(), matrix(cell.values.field("v"), width)


#: A table is cut into so many parts, unless a part would then have fewer rows than a block or more than LARGEST.
PARTS, LARGEST = 48, 262_144


def parts_of(rows: int, block: int) -> int:
    """Into how many parts a table is cut: what asks is copied to each, so their number hardly grows with the table."""
    return max(1, -(-rows // max(block, min(LARGEST, -(-rows // PARTS)))))


def beside(vectors: DataFrame, asking: DataFrame, parts: int) -> DataFrame:
    """part, asks, the columns of ``asking``: each part's vectors by id, then all rows that ask.

    One shuffled row per vector and per asking row and part; nobody holds more than a part.
    """
    extra = [F.lit(None).cast(asking.schema[c].dataType).alias(c) for c in asking.columns if c not in vectors.columns]
    dealt = F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")
    v = vectors.select(dealt.alias("part"), F.lit(False).alias("asks"), "*", *extra)
    q = asking.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(True).alias("asks"), "*")
    return v.unionByName(q).repartition("part").sortWithinPartitions("part", "asks", "vec_id")


def runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
    """The rows of ``beside`` again: part, whether they ask, rows of one kind (those that ask at most ``most`` at a time)."""
    for batch in batches:
        part, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (asks[1:] != asks[:-1])]) if len(part) else []
        for a, b in zip(edges, [*edges[1:], len(part)]):
            step = most if asks[a] else b - a
            for at in range(a, b, step):
                yield int(part[a]), bool(asks[a]), batch.slice(at, min(step, b - at))


def matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    """Doubles with ``width`` columns; shorter vectors are filled with zeros."""
    lengths = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy().astype(np.float64)
    if (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lists), width))
    out[np.repeat(np.arange(len(lists)), lengths), np.concatenate([np.arange(n) for n in lengths])] = flat
    return out


def small(whole: np.ndarray) -> np.ndarray:
    """Whole numbers in half the space where that loses nothing."""
    return whole.astype(np.float32) if np.abs(whole).max(initial=0) < 2**24 else whole


def segments(n: int, least: int = 256, most: int = 2048) -> Iterator[tuple[int, int]]:
    """Bounds of runs of n rows: short ones first, so that bounds are known early."""
    a = 0
    while a < n:
        b = min(n, a + min(most, max(least, a)))
        yield a, b
        a = b


class Held:
    """The k best (id, whole score) of each of n keys, ties to the smaller id; what is added waits until it is many."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.keys = self.ids = self.scores = np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.many = 0
        self.full = np.zeros(n, bool)  # keys with k rows: score and id of the last of them
        self.score, self.last = np.zeros(n, np.int64), np.zeros(n, np.int64)

    def add(self, keys: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        fit = ~self.full[keys] | (scores > self.score[keys]) | ((scores == self.score[keys]) & (ids < self.last[keys]))
        self.waiting.append((keys[fit], ids[fit], scores[fit]))
        self.many += int(fit.sum())
        if self.many >= self.n * self.k:
            self.settle()

    def settle(self) -> None:
        if not self.many:
            return
        keys, ids, scores = (np.concatenate(x) for x in zip((self.keys, self.ids, self.scores), *self.waiting))
        order = np.lexsort((ids, ~scores, keys))  # ~x falls as x rises and has no overflow
        keys, ids, scores = keys[order], ids[order], scores[order]
        first = np.searchsorted(keys, keys)
        at = np.arange(len(keys)) - first < self.k
        self.keys, self.ids, self.scores, self.waiting, self.many = keys[at], ids[at], scores[at], [], 0
        end = np.flatnonzero((np.arange(len(keys)) - first)[at] == self.k - 1)
        self.full[self.keys[end]] = True
        self.score[self.keys[end]], self.last[self.keys[end]] = self.scores[end], self.ids[end]

    def bound(self, otherwise: float | np.ndarray) -> np.ndarray:
        """Scores below it are out, as doubles."""
        return np.where(self.full, self.score, otherwise).astype(np.float64)


def best(found: DataFrame, k: int, score: str) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest of each query, ties to the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("score").cast(score).alias("score"))


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= edge)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]
