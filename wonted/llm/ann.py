"""Approximate nearest neighbours by largest inner product: inverted lists with adaptive dimension scan.

Vectors get one more component, the root of (greatest squared norm - own squared norm); queries get 0 there.  Then
the largest inner product is the smallest distance, and all of it is rotated by one random orthogonal matrix.

* Lists: k-means centres fitted on a bounded sample (``sample_rows``, in order of a hash of the id); every vector
  is indexed in its nearest list.  A query probes the lists nearest to it: ``share`` of all,
  and at least as many as hold more than enough vectors.  Vectors without any clusters need a large share (0.7
  gives a recall of 0.94 to 0.98 on them); with clusters a much smaller one will do.
* The nearest lists of a query, as many as hold enough vectors, are measured in full and give its bound: the k-th
  best distance there.  The bounds, a number a query, go with the queries to all other lists they probe.
* Scan: there, the rotated components lie in column blocks.  After each block the partial squared distance,
  scaled to all dimensions, is tested against the query's k-th best distance so far; a candidate is abandoned
  when it is beyond (1 + epsilon / sqrt(dimensions seen)) times that, which a random rotation makes unlikely for
  true neighbours.
* Survivors are scored exactly, in double precision on the original vectors.

Lists are cut into cells of bounded size, so a list with very many equal vectors is many cells.  Recall against
brute force is measured in the tests (at least 0.9).

Vectors null, zero or with null or non-finite components, and null ids, take no part; rows that share an id count
once (the largest vector); shorter vectors count as filled with zeros; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wonted.llm.common import read, saved
from wonted.llm.vectors import best, cells, top, unpacked, usable

COLUMN_BLOCK = 16
LISTS = pa.list_(pa.struct([("list", pa.int32()), ("near", pa.bool_())]))
EPSILON = 2.1


def centres(sample: np.ndarray, k: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    """k-means by Lloyd's rounds; an empty centre takes a random row."""
    rng = np.random.default_rng(seed)
    at = sample[rng.choice(len(sample), k, replace=False)]
    for _ in range(rounds):
        own = nearest(sample, at)
        total = np.zeros_like(at)
        np.add.at(total, own, sample)
        n = np.bincount(own, minlength=k)
        at = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], sample[rng.integers(0, len(sample), k)])
    return at


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared, of all rows of x to all rows of y."""
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T), 0)


def nearest(x: np.ndarray, at: np.ndarray, block: int = 4096) -> np.ndarray:
    return np.concatenate([distances(x[a : a + block], at).argmin(1) for a in range(0, len(x), block)] or [np.zeros(0, int)])


def scan(q: np.ndarray, v: np.ndarray, barred: np.ndarray, k: int, bound: np.ndarray | None = None, tile: int = 512, told: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(query, vector) places that may be among the k nearest of a query; q and v are rotated, barred pairs are left out.

    bound: greatest squared distance that still counts, by query (infinite: unknown).  Without any the first tile is measured in full and
    gives the bounds; the rest is scanned adaptively and sharpens them.  told: counts pairs, those abandoned, and components read.
    """
    width, m = q.shape[1], len(q)
    bound, pool = np.full(m, np.inf) if bound is None else bound.copy(), [[] for _ in range(m)]
    rows, columns, found = [], [], []
    for a in range(0, len(v), tile):
        part = v[a : a + tile]
        if not np.isfinite(bound).all():
            i, j = np.nonzero(~barred[:, a : a + tile])
            d = distances(q, part)[i, j]
            read_ = len(i) * width
        else:
            seen = min(COLUMN_BLOCK, width)
            d = distances(q[:, :seen], part[:, :seen])
            limit = (bound * (1 + EPSILON / np.sqrt(seen)) ** 2 * seen / width)[:, None] if seen < width else bound[:, None] * (1 + 1e-9)
            i, j = np.nonzero((d <= limit + 1e-9) & ~barred[:, a : a + tile])
            read_ = d.size * seen
            d = d[i, j]
            while seen < width and len(i):
                upto = min(seen + COLUMN_BLOCK, width)
                d = d + ((q[i, seen:upto] - part[j, seen:upto]) ** 2).sum(1)
                read_ += len(i) * (upto - seen)
                seen = upto
                slack = (1 + EPSILON / np.sqrt(seen)) ** 2 * seen / width if seen < width else 1 + 1e-9
                keep = d <= bound[i] * slack + 1e-9
                i, j, d = i[keep], j[keep], d[keep]
        if told is not None:
            for name, n in (("pairs", m * len(part)), ("abandoned", m * len(part) - len(i)), ("components", read_)):
                told[name] = told.get(name, 0) + n
        rows.append(i)
        columns.append(j + a)
        found.append(d)
        ends = np.searchsorted(i, np.arange(m + 1))  # i ascends
        for x in np.flatnonzero(np.diff(ends)):
            pool[x] = np.concatenate([pool[x], d[ends[x] : ends[x + 1]]])
            if len(pool[x]) >= k:
                pool[x] = np.partition(pool[x], k - 1)[:k]
                bound[x] = min(bound[x], pool[x][-1])
    i, j, d = (np.concatenate(x) for x in (rows, columns, found)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    keep = d <= bound[i] * (1 + 1e-6) + 1e-9
    return i[keep], j[keep]


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, sample_rows: int = 20_000, share: float = 0.7, block: int = 4096, query_block: int = 512, seed: int = 11) -> DataFrame:
    """query_id, rank, vec_id, score of vectors (vec_id, v)."""
    norm = F.expr("aggregate(v, double(0), (a, x) -> a + double(x) * double(x))")
    n, width, longest = vectors.agg(F.count("*"), F.max(F.size("v")), F.max(norm)).first()
    if not n:
        return vectors.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    stored = dict(vectors.dtypes)["v"]
    turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(width + 1, width + 1)))[0]

    def rotated(x: np.ndarray, extend: bool) -> np.ndarray:
        last = np.sqrt(np.maximum(longest - (x * x).sum(1), 0)) if extend else np.zeros(len(x))
        return np.hstack([x, last[:, None]]) @ turn

    def matrix(column: pa.Array) -> np.ndarray:
        out = np.zeros((len(column), width))
        for i, x in enumerate(column):
            out[i, : len(x)] = x.values.to_numpy()
        return out

    sample = vectors.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(sample_rows).select("v").toArrow().column(0)
    sample = rotated(matrix(sample), True)
    at = centres(sample, max(1, min(1024, int(np.sqrt(n)), len(sample))))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = nearest(rotated(matrix(b.column(1)), True), at)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own.astype(np.int32))], names=["vec_id", "v", "list"])

    indexed = saved(vectors.select("vec_id", "v").mapInArrow(assign, f"vec_id long, v {stored}, list int"))
    sizes = np.zeros(len(at), np.int64)
    for r in indexed.groupBy("list").count().collect():  # at most 1024 rows
        sizes[r["list"]] = r["count"]
    probes = max(1, int(np.ceil(share * len(at))))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            order = distances(rotated(matrix(b.column(1)), False), at).argsort(1, kind="stable")
            held = np.cumsum(sizes[order], 1)
            near = (held <= 4 * k).sum(1) + 1
            n_lists = np.maximum(probes, near)
            lists = [[(int(x), i < c) for i, x in enumerate(o[:n]) if sizes[x]] for o, n, c in zip(order, n_lists, near)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([[{"list": x, "near": y} for x, y in z] for z in lists], LISTS)], names=["vec_id", "v", "lists"])

    asked = queries.select("vec_id", "v").mapInArrow(probe, f"vec_id long, v {stored}, lists array<struct<list:int,near:boolean>>")
    asked = saved(asked).select("vec_id", "v", F.explode("lists").alias("l")).select("vec_id", "v", "l.list", "l.near")

    per_list = lambda df, size: df.join(F.broadcast(df.groupBy("list").agg(F.ceil(F.count("*") / size).alias("parts"))), "list")  # noqa: E731  at most 1024 rows
    v = cells(per_list(indexed, block), ["list"], F.col("parts"), "all")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                qid, qv = unpacked(batch.column(1)[r], width)
                vid, vv = unpacked(batch.column(0)[r], width)
                floor = batch.column(1)[r].values.field("floor").to_numpy(zero_copy_only=False).astype(np.float64)  # null: nan
                bound = np.where(np.isnan(floor), np.inf, np.maximum(longest + (qv * qv).sum(1) - 2 * floor, 0) * (1 + 1e-6))
                i, j = scan(rotated(qv, False), rotated(vv, True), qid[:, None] == vid[None, :], k, bound)
                order = np.argsort(i, kind="stable")
                i, j = i[order], j[order]
                scores = (qv[i] * vv[j]).sum(1)
                ends = np.searchsorted(i, np.arange(len(qid) + 1))
                picked = [x + top(scores[x:y], vid[j[x:y]], k) for x, y in zip(ends, ends[1:]) if y > x]
                at_ = np.concatenate([*picked, np.zeros(0, np.int64)]).astype(np.int64)
                arrays = [pa.array(qid[i[at_]]), pa.array(vid[j[at_]]), pa.array(scores[at_])]
                yield pa.RecordBatch.from_arrays(arrays, names=["query_id", "vec_id", "score"])

    def probed(rows: DataFrame) -> DataFrame:
        """Each query's best in its lists (vec_id, v, list, floor: the least score that counts, or null)."""
        sized = per_list(rows, query_block)
        part = F.pmod(F.xxhash64("vec_id"), F.col("parts"))
        q = sized.groupBy("list", part.alias("asked_part")).agg(F.collect_list(F.struct("vec_id", "v", "floor")).alias("asked"))
        met = v.join(q, "list").select("all", "asked").repartition(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        return met.mapInArrow(work, "query_id long, vec_id long, score double")

    nearest_ = saved(best(probed(asked.filter("near").withColumn("floor", F.lit(None).cast("double"))), k, "double"))
    floors = nearest_.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    others = probed(asked.filter("not near").join(floors, "vec_id", "left"))
    return best(nearest_.select("query_id", "vec_id", "score").union(others), k, "double")


def query(spark, folder: str) -> DataFrame:
    vectors = saved(usable(read(spark, folder, "embeddings"), zero=False))
    return search(vectors, vectors.filter("vec_id % 20 = 0"))
