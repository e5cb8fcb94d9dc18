"""Quality of documents by a factorisation machine.

Inputs of a score: the text's words, hashed (present or not, scaled by the root of their number), statistics of
its structure (shares of kinds of bytes, word lengths, repetition, lines) and the length that the table declares.
The model is a weight per input plus all pairwise interactions through vectors of ``FACTORS`` numbers, summed in
linear time: half of (square of the sum minus sum of the squares), per factor.

Training sees at most ``max_rows`` labelled rows, in order of a hash of their id; it runs on the driver over their
hashed inputs.  Scoring runs over every document and its whole text in the tasks.

Results for odd input: null and empty texts get a score from the statistics alone (all zero); nulls in other
columns are zeros; null ids are scored and never learned from; several labels of one id count as the highest;
without any label every score is 0.5; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wonted.llm.common import DOCUMENT_COLUMNS, read
from wonted.llm.hashing import chunks, text_bytes, words

BITS = 15
BUCKETS = 1 << BITS
FACTORS = 8
THRESHOLD = 0.3

#: Kinds of bytes whose shares are inputs.
KINDS = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "blank": (9, 11, 12, 13, 32), "line": (10,),
    "stop": map(ord, ".,;:'\"-()"), "loud": map(ord, "!?"), "sign": map(ord, "#$%&*+/<=>@[\\]^_`{|}~"), "wide": range(128, 256),
}
KIND_OF = np.zeros((len(KINDS), 256), bool)
for _row, _bytes in zip(KIND_OF, KINDS.values()):
    _row[list(_bytes)] = True
STATS = len(KINDS) + 8


def inputs(texts: pa.Array, declared: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per chunk of documents a to b: buckets of the distinct hashed words, their ends per document, statistics."""
    data, offsets = text_bytes(texts)
    for a, b in chunks(offsets):
        off = offsets[a : b + 1] - offsets[a]
        part = data[offsets[a] : offsets[b]]
        h, start, end, first = words(part, off)
        doc = np.repeat(np.arange(b - a), np.diff(first))
        distinct = np.unique((doc << BITS) | (h >> np.uint64(64 - BITS)).astype(np.int64))
        ends = np.searchsorted(distinct, np.arange(b - a + 1) << BITS)
        size, n_words, n_distinct = np.diff(off), np.diff(first), np.diff(ends)
        stats = np.zeros((b - a, STATS))
        for i, kind in enumerate(KIND_OF):
            c = np.concatenate([[0], np.cumsum(kind[part])])
            stats[:, i] = np.diff(c[off]) / np.maximum(size, 1)
        long_ = np.concatenate([[0], np.cumsum(end - start)])
        lines = np.concatenate([[0], np.cumsum(part == 10)])
        same = np.zeros(len(h) + 1, bool)
        same[1:-1] = h[1:] == h[:-1]
        same[first] = False  # a first word follows none
        again = np.concatenate([[0], np.cumsum(same[:-1])])
        mark = np.concatenate([[0], np.cumsum((end - start == 1) & KIND_OF[7][part[start]])]) if len(start) else np.zeros(1)
        capital = np.concatenate([[0], np.cumsum(KIND_OF[0][part[start]])]) if len(start) else np.zeros(1)
        stats[:, len(KINDS) :] = np.stack(
            [
                np.diff(long_[first]) / np.maximum(n_words, 1) / 10,
                n_distinct / np.maximum(n_words, 1),
                np.log1p(n_words) / 10,
                np.diff(lines[off]) / np.maximum(n_words, 1),
                np.diff(capital[first]) / np.maximum(n_words, 1) if len(start) else np.zeros(b - a),
                np.diff(again[first]) / np.maximum(n_words, 1),
                np.diff(mark[first]) / np.maximum(n_words, 1) if len(start) else np.zeros(b - a),
                np.log1p(np.maximum(declared[a:b], 0)) / 15,
            ],
            axis=1,
        )
        yield a, b, distinct & (BUCKETS - 1), ends, stats


@dataclass
class Machine:
    """bias, weight and vector per input: hashed words first, then the standardised statistics."""

    bias: float
    weight: np.ndarray
    vector: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def _sums(self, bucket, ends, stats):
        x = np.clip((stats - self.mean) / self.spread, -6, 6)
        scale = 1 / np.sqrt(np.maximum(np.diff(ends), 1))
        table = np.hstack([self.weight[:BUCKETS, None], self.vector[:BUCKETS]])
        rows = table[bucket]

        def per_document(v):
            c = np.vstack([np.zeros((1, v.shape[1])), np.cumsum(v, axis=0, dtype=np.float64)])
            return c[ends[1:]] - c[ends[:-1]]

        w_stats, v_stats = self.weight[BUCKETS:], self.vector[BUCKETS:]
        total = per_document(rows)
        linear = total[:, 0] * scale + x @ w_stats
        first = total[:, 1:] * scale[:, None] + x @ v_stats
        second = per_document((rows[:, 1:] ** 2).sum(1, keepdims=True))[:, 0] * scale**2 + x**2 @ (v_stats**2).sum(1)
        return x, scale, linear, first, second

    def score(self, bucket: np.ndarray, ends: np.ndarray, stats: np.ndarray) -> np.ndarray:
        _, _, linear, first, second = self._sums(bucket, ends, stats)
        z = self.bias + linear + 0.5 * ((first**2).sum(1) - second)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(buckets: list[np.ndarray], stats: np.ndarray, labels: np.ndarray, batch: int = 128, rate: float = 0.05, decay: float = 1e-3, seed: int = 3) -> Machine:
    """Logistic loss, AdaGrad over shuffled batches.

    There are 50,000 / rows passes, 12 at least and 100 at most: few rows are seen more often."""
    rng = np.random.default_rng(seed)
    n = len(labels)
    share = np.clip(labels.mean(), 0.01, 0.99) if n else 0.5
    m = Machine(
        float(np.log(share / (1 - share))), np.zeros(BUCKETS + STATS), rng.normal(0, 0.02, (BUCKETS + STATS, FACTORS)),
        stats.mean(0) if n else np.zeros(STATS), stats.std(0) + 1e-3 if n else np.ones(STATS),
    )
    seen_w, seen_v, seen_b = np.full(len(m.weight), 1e-6), np.full(m.vector.shape, 1e-6), 1e-6
    for _ in range(min(100, max(12, 50_000 // max(n, 1)))):
        order = rng.permutation(n)
        for at in range(0, n, batch):
            rows = order[at : at + batch]
            bucket = np.concatenate([buckets[r] for r in rows])
            ends = np.cumsum([0, *(len(buckets[r]) for r in rows)])
            x, scale, linear, first, second = m._sums(bucket, ends, stats[rows])
            z = m.bias + linear + 0.5 * ((first**2).sum(1) - second)
            g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[rows]) / len(rows)
            # words: gradient of w is g * x, of v is g * x * (sum - v * x)
            gs = np.repeat(g * scale, np.diff(ends))
            gs2 = np.repeat(g * scale**2, np.diff(ends))
            inner = np.repeat(first, np.diff(ends), axis=0)
            used, back = np.unique(bucket, return_inverse=True)
            gw = np.bincount(back, gs, len(used)) + decay * m.weight[used] / 100
            gv = np.stack([np.bincount(back, gs * inner[:, f] - gs2 * m.vector[bucket, f], len(used)) for f in range(FACTORS)], 1)
            used = np.concatenate([used, BUCKETS + np.arange(STATS)])
            sv = m.vector[BUCKETS:]
            gw = np.concatenate([gw, x.T @ g + decay * m.weight[BUCKETS:] / 100])
            gv = np.vstack([gv, (x * g[:, None]).T @ first - (x**2).T @ g[:, None] * sv]) + decay * m.vector[used]
            seen_w[used] += gw**2
            seen_v[used] += gv**2
            seen_b += g.sum() ** 2
            m.weight[used] -= rate * gw / np.sqrt(seen_w[used])
            m.vector[used] -= rate * gv / np.sqrt(seen_v[used]) * 0.2
            m.bias -= rate * g.sum() / np.sqrt(seen_b)
    return m


def _held_out(doc_id) -> F.Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def _prepared(docs: DataFrame, *others: str) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    return docs.select(text, F.coalesce(F.col("n_chars").cast("double"), F.lit(0.0)).alias("declared"), *others)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 6000) -> Machine:
    """Learned from at most ``max_rows`` labelled documents that are not held out."""
    chosen = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("label"))
    chosen = chosen.filter("id is not null and label in (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    chosen = chosen.filter(~_held_out(F.col("id"))).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    rows = _prepared(docs, F.col("doc_id").cast("long").alias("id")).join(F.broadcast(chosen), "id")  # at most max_rows rows

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, bucket, ends, stats in inputs(batch.column(0), batch.column(1).to_numpy()):
                arrays = [
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(bucket, pa.int32())),
                    pa.array(list(stats), pa.list_(pa.float64())),
                ]
                yield pa.RecordBatch.from_arrays([*arrays, batch.column(2)[a:b], batch.column(3)[a:b]], names=["bucket", "stats", "id", "label"])

    rows = rows.groupBy("id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("declared").alias("declared"))
    learned = rows.select("text", "declared", "id", "label").mapInArrow(work, "bucket array<int>, stats array<double>, id long, label int")
    found = learned.toArrow().sort_by("id")
    stats = np.array(found.column("stats").to_pylist(), float).reshape(-1, STATS)
    return train([x.values.to_numpy() for x in found.column("bucket")], stats, found.column("label").to_numpy().astype(float))


def scored(docs: DataFrame, machine: Machine) -> DataFrame:
    """The columns of documents and score."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = [machine.score(bucket, ends, stats) for _, _, bucket, ends, stats in inputs(batch.column(0), batch.column(1).to_numpy())]
            score = pa.array(np.concatenate([*score, np.zeros(0)]))
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], score], names=[*others, "score"])

    others = [c for c in DOCUMENT_COLUMNS if c in docs.columns]
    types = {**dict(docs.dtypes)}
    return _prepared(docs, *[F.col(c).alias(f"own_{c}") for c in others]).mapInArrow(work, ", ".join(f"{c} {types[c]}" for c in others) + ", score double")


def query(spark, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    machine = fit(docs, read(spark, folder, "labels"))
    result = scored(docs.select("doc_id", "text", "n_chars"), machine)
    return result.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def stage(spark, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose score is at least ``THRESHOLD``."""
    machine = fit(docs, read(spark, folder, "labels"))
    return scored(docs, machine).filter(F.col("score") >= THRESHOLD).drop("score")
