"""Exact top-k inner products from an impact-ordered, score-at-a-time index.

Components are integers.  The index of a part of the vectors has the dimensions by descending energy and the vectors by
descending norm, cut into segments: the postings of a run of vectors in a run of dimensions.  A block of queries takes
the segments by descending impact and adds query times component to the accumulators of the segment's vectors.

At any time a score differs from its accumulator by at most the product of what is left of the query's and of the
vector's norm, and rounding.  Vectors that stay below the k-th best score so far by more than that are proven out;
once the norms themselves are too small for all queries, the part's other segments are not taken.  What is left is
scored exactly.  The parts' winners meet in a window per query.

Vectors null or with null or non-finite components, and null ids, take no part; rows that share an id count once
(the largest vector); shorter vectors count as filled with zeros; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wonted.llm.common import read, saved
from wonted.llm.vectors import Held, beside, best, matrix, parts_of, runs, segments, small, usable

#: Shares of the dimensions after which the proof is tried.
STEPS = (0.25, 0.5, 0.75, 1.0)


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64))


class ImpactIndex:
    """Postings of one part: dimensions by descending energy, vectors by descending norm."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        size, width = norms(vectors), vectors.shape[1]
        order = np.lexsort((ids, -size))
        self.dims = np.argsort(-np.einsum("ij,ij->j", vectors, vectors, dtype=np.float64), kind="stable")
        self.ids, self.vectors = ids[order], vectors[np.ix_(order, self.dims)]
        self.cuts = sorted({round(share * width) for share in STEPS})
        self.bounds = list(segments(len(ids)))
        #: by segment and cut: the greatest norm of what lies behind the cut
        self.left = np.array([[norms(self.vectors[a:b, c:]).max() for c in [0, *self.cuts]] for a, b in self.bounds])

    def search(self, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """ids and exact scores of the k best, own id left out."""
        _, ids, scores = self.search_all(q[None, :], np.array([own]), k)
        return ids, scores

    def search_all(self, queries: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of queries, ids and exact scores of the k best of each, by descending score; own ids left out."""
        held, q = Held(len(queries), k), queries[:, self.dims].astype(np.float64)
        least = self.left[:, 0].max(initial=0) * norms(q)  # rounding, where accumulators may not be exact
        rounding = np.where(least < 2**24, 0.0, (q.shape[1] + 4) * 2.0**-23 * least)
        kind = np.float32 if least.max(initial=0) < 1e30 and np.abs(q).max(initial=0) < 1e30 else np.float64
        low, q_left = q.astype(kind), np.array([norms(q[:, c:]) for c in [0, *self.cuts]])
        useful = dict.fromkeys(self.cuts, True)
        for (a, b), v_left in zip(self.bounds, self.left):
            bound = held.bound(-np.inf) - rounding
            rows = np.flatnonzero(q_left[0] * v_left[0] * (1 + 1e-9) >= bound)
            if not len(rows):
                break  # later vectors are no longer than these
            part = self.vectors[a:b].astype(kind, copy=False)
            total, done = None, 0
            for cut, v, each in zip(self.cuts, v_left[1:], q_left[1:]):
                rest = v * each[rows] * (1 + 1e-9)
                if cut < q.shape[1] and not (useful[cut] and (rest < bound[rows] / 2).mean() > 0.5):
                    continue
                taken = low[rows, done:cut] @ part[:, done:cut].T
                total, done = taken if total is None else total + taken, cut
                stay = total.max(axis=1) >= bound[rows] - rest
                useful[cut] = stay.mean() < 0.75  # else the next segments pass this cut by
                rows, total = (rows, total) if stay.all() else (rows[stay], total[stay])
            edge = bound[rows]
            if b - a > k + 1:  # one more than k: own may be among them
                unknown = np.flatnonzero(~held.full[rows])
                edge[unknown] = np.partition(total[unknown], b - a - k - 1, axis=1)[:, b - a - k - 1] - 2 * rounding[rows[unknown]]
            i, j = divmod(np.flatnonzero(total >= edge.astype(kind)[:, None]), b - a)
            i, j = rows[i], a + j
            i, j = (x[self.ids[j] != own[i]] for x in (i, j))
            scores = np.einsum("ij,ij->i", q[i], self.vectors[j], dtype=np.float64)  # integers far below 2^53: exact
            held.add(i, self.ids[j], scores.astype(np.int64))
        held.settle()
        return held.keys, held.ids, held.scores


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = 8192, query_block: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score over integer vectors (vec_id, v)."""
    n, width = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
    width = width or 0

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows, index = None, [], None
        for this, asks, batch in runs(batches, query_block):
            if this != part:
                part, rows, index = this, [], None
            ids, v = batch.column(2).to_numpy(), matrix(batch.column(3), width)
            if not asks:
                rows.append((ids, small(v)))
            elif rows or index:
                if rows:
                    index, rows = ImpactIndex(*(np.concatenate(x) for x in zip(*rows))), []
                at, found, scores = index.search_all(v, ids, k)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[at], found, scores)], names=["query_id", "vec_id", "score"])

    met = beside(vectors.select("vec_id", "v"), queries.select("vec_id", "v"), parts_of(n, block))
    return best(met.mapInArrow(work, "query_id long, vec_id long, score long"), k, "long")


def integers(table: DataFrame) -> DataFrame:
    """vec_id and floor(1024 * x) of every component."""
    return usable(table, zero=True).select("vec_id", F.expr("transform(v, x -> double(floor(1024 * double(x))))").alias("v"))


def query(spark, folder: str) -> DataFrame:
    vectors = saved(integers(read(spark, folder, "embeddings")))
    return search(vectors, vectors.filter("vec_id % 100 = 0"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(row_number() OVER w AS INT) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10"""
