"""Hard negatives by a secondary sort: rows that score high for an anchor but have another label.

* Scores are integer inner products of blocks of anchors with parts of the vectors; a part hands on only what
  may still be asked for, so shuffled rows grow with anchors times parts, never with all pairs: first its best
  rows of the anchor's own label (which alone are multiplied), then, for each positive found, its best rows of other
  labels in the positive's window (low * positive <= 100 * negative <= high * positive).  Both selections are exact, as
  a row that is not among the first of its part is not among the first of all.  Within a part, runs of vectors are
  multiplied in turn, and only scores that reach a window above its last row so far are looked at.
* Positives and negatives meet under the key (anchor, descending score, positive before negative, id): rows are
  dealt out by anchor and sorted within partitions, and one iterator passes over them.  A positive opens a window,
  a negative is emitted for every open window that holds it, a window closes with its last negative.  The iterator
  knows the open windows of one anchor (at most ``positives``) and never gathers an anchor's rows.

Rows with a null id, label or vector, or with a null or non-finite component, take no part.  Rows that share an id
count once (the largest vector, then the largest label).  Shorter vectors count as filled with zeros.  Products beyond
64 bits count as the nearest such integer.  Empty tables and anchors without a positive give no rows.  Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wonted.llm.common import read, saved
from wonted.llm.vectors import Held, beside, matrix, parts_of, runs, segments, small

MOST = 2**63 - 1
PAIR = "anchor_id long, vec_id long, score long"


def usable(table: DataFrame) -> DataFrame:
    """vec_id, label, v (as stored) of the rows that take part, one per id."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").alias("v"))
    rows = rows.filter("vec_id is not null and label is not null and v is not null")
    rows = rows.filter("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    return rows.groupBy("vec_id").agg(F.max(F.struct("v", "label")).alias("r")).select("vec_id", "r.label", "r.v")


def whole(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x), whole numbers as floats."""
    return small(np.floor(scale * np.clip(x, -1e300, 1e300)))


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, rows of q by rows of v, exact up to 64 bits (as floats where those are exact)."""
    size = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * q.shape[1]
    if 2**24 <= size < 1e30:  # norms tell more
        size = min(size, np.prod([np.sqrt(np.square(x, dtype=float).sum(axis=1).max(initial=0)) for x in (q, v)]))
    if size < 2**24 - 1:  # no sum of some of the products is larger
        return q.astype(np.float32, copy=False) @ v.astype(np.float32, copy=False).T
    if size < 2**53 - 1:
        return q.astype(float) @ v.astype(float).T
    ints = np.vectorize(int, otypes=[object])
    exact = ints(q).dot(ints(v).T)
    return np.vectorize(lambda x: max(-MOST, min(MOST, x)), otypes=[np.int64])(exact)


def window(positive: int, low: int, high: int) -> tuple[int, int]:
    """Least and greatest negative score n with low * positive <= 100 * n <= high * positive."""
    return -(-low * positive // 100), high * positive // 100


def bounds(positives: pa.ListArray, places: int, low: int, high: int) -> np.ndarray:
    """By row and place, least and greatest negative of a positive score, within 64 bits; least > greatest where no window is."""
    out = np.tile(np.array([[MOST], [-MOST]]), (len(positives), 1, places))
    lengths = np.diff(positives.offsets.to_numpy())
    row, flat = np.repeat(np.arange(len(lengths)), lengths), positives.flatten().to_numpy()
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    if len(flat) and max(-int(flat.min()), int(flat.max())) * max(abs(low), abs(high)) >= 2**62:
        flat = flat.astype(object)
    least, most = window(flat, low, high)
    at = np.flatnonzero((least <= MOST) & (most >= -MOST))
    out[row[at], 0, place[at]] = np.maximum(least[at], -MOST)
    out[row[at], 1, place[at]] = np.minimum(most[at], MOST)
    return out


class Part:
    """One part of the vectors, by label and id."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray):
        order = np.lexsort((ids, labels))
        self.ids, self.labels, self.v = ids[order], labels[order], v[order]

    def positives(self, anchors: np.ndarray, labels: np.ndarray, q: np.ndarray, k: int) -> Held:
        """The k best rows of its own label for each anchor."""
        held = Held(len(anchors), k)
        for label in np.unique(labels):
            rows = np.flatnonzero(labels == label)
            start, end = np.searchsorted(self.labels, label), np.searchsorted(self.labels, label, "right")
            for a, b in segments(end - start):
                scores = products(q[rows], self.v[start + a : start + b])
                floor = held.bound(-np.inf)[rows]
                if b - a > k + 1:  # one more than k: the anchor may be among them
                    new = np.flatnonzero(~held.full[rows])
                    floor[new] = np.partition(scores[new], b - a - k - 1, axis=1)[:, b - a - k - 1]
                i, j = reached(scores, floor, None)
                i, s, j = rows[i], scores[i, j], start + a + j
                at = self.ids[j] != anchors[i]
                held.add(i[at], self.ids[j[at]], s[at].astype(np.int64))
        held.settle()
        return held

    def negatives(self, labels: np.ndarray, q: np.ndarray, windows: np.ndarray, k: int) -> Held:
        """The k best rows of other labels for each (anchor, place); windows: least and greatest by anchor and place."""
        places = windows.shape[2]
        held, open_ = Held(len(labels) * places, k), windows[:, 0] <= windows[:, 1]
        most = windows[:, 1].max(axis=1)
        for a, b in segments(len(self.ids)):
            scores = products(q, self.v[a:b])
            floors = np.where(open_, held.bound(windows[:, 0].ravel()).reshape(-1, places), np.inf)
            least = floors.min(axis=1)
            rows = np.flatnonzero(scores.max(axis=1) >= least)
            i, j = reached(scores[rows], least[rows], most[rows])
            i, j = rows[i], j + a
            i, j = (x[self.labels[j] != labels[i]] for x in (i, j))
            s = scores[i, j - a].astype(np.int64)
            for place in range(places):
                at = np.flatnonzero((s >= floors[i, place]) & (s <= windows[i, 1, place]))
                at = at[s[at] >= windows[i[at], 0, place]]  # floors are rounded beyond 2^53
                held.add(i[at] * places + place, self.ids[j[at]], s[at])
        held.settle()
        return held


def reached(scores: np.ndarray, floor: np.ndarray, ceiling: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of scores from floor to ceiling of the row.  Rounded bounds only let more through."""
    kind = scores.dtype if scores.dtype.kind == "f" else np.float64
    at = scores >= np.nextafter(floor.astype(kind), -np.inf)[:, None]
    if ceiling is not None:
        at &= scores <= np.nextafter(ceiling.astype(kind), np.inf)[:, None]
    return divmod(np.flatnonzero(at), max(1, scores.shape[1]))


def pairs(anchors: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in (anchors, ids, scores)], names=["anchor_id", "vec_id", "score"])


def mine(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0, block: int = 4096, anchor_block: int = 512) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of (vec_id, label, v)."""
    rows, width = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
    width = width or 0

    parts = parts_of(rows, block)

    def met(batches: Iterator[pa.RecordBatch]):
        part, gathered, index = None, [], None
        for this, asks, batch in runs(batches, anchor_block):
            if this != part:
                part, gathered, index = this, [], None
            ids, labels, v = batch.column(2).to_numpy(), batch.column(3).to_numpy(), whole(matrix(batch.column(4), width), scale)
            if not asks:
                gathered.append((ids, labels, v))
            elif gathered or index:
                if gathered:
                    index, gathered = Part(*(np.concatenate(x) for x in zip(*gathered))), []
                yield index, ids, labels, v, batch

    def best_positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, labels, q, _ in met(batches):
            held = part.positives(ids, labels, q, positives)
            yield pairs(ids[held.keys], held.ids, held.scores)

    def best_negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, labels, q, batch in met(batches):
            held = part.negatives(labels, q, bounds(batch.column(5), positives, low, high), negatives)
            found = np.unique(np.stack([held.keys // positives, held.ids, held.scores]), axis=1)  # once for all its windows
            yield pairs(ids[found[0]], found[1], found[2])

    columns = ["vec_id", "label", "v"]
    near = beside(vectors.select(columns), anchors.select(columns), parts).mapInArrow(best_positives, PAIR)
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    chosen = saved(near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives).drop("place"))

    per_anchor = chosen.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list("score").alias("positive_scores"))
    asked = anchors.join(per_anchor, "vec_id").select(*columns, "positive_scores")  # ``positives`` scores an anchor
    far = beside(vectors.select(columns), asked, parts).mapInArrow(best_negatives, PAIR)
    keyed = chosen.withColumn("negative", F.lit(False)).unionByName(far.withColumn("negative", F.lit(True)))
    keyed = keyed.select("anchor_id", "score", "negative", "vec_id")
    ordered = keyed.repartition("anchor_id").sortWithinPartitions("anchor_id", F.desc("score"), "negative", "vec_id")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, open_ = None, []
        for batch in batches:
            out = []
            for anchor, score, negative, vec_id in zip(*(c.to_pylist() for c in batch.columns)):
                if anchor != current:
                    current, open_ = anchor, []
                if not negative:
                    open_.append([vec_id, score, *window(score, low, high), 0])
                    continue
                for w in open_:
                    if w[2] <= score <= w[3]:
                        w[4] += 1
                        out.append((anchor, w[0], w[4], vec_id, w[1], score))
                open_ = [w for w in open_ if w[4] < negatives and score >= w[2]]
            names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
            columns = list(zip(*out)) or [()] * 6
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return ordered.mapInArrow(windows, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def query(spark, folder: str) -> DataFrame:
    rows = usable(read(spark, folder, "embeddings"))
    rows = saved(rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))
    return mine(rows, rows.filter("vec_id % 50 = 0"))


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS same, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 3"""
