"""The factorisation machine: inputs, identity, held-out accuracy, odd tables."""

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from cases import odd_rows, plain

from wonted.llm import quality
from wonted.llm.common import read


def machine(seed=2):
    rng = np.random.default_rng(seed)
    n = quality.BUCKETS + quality.STATS
    return quality.Machine(0.3, rng.normal(size=n), rng.normal(size=(n, quality.FACTORS)), np.zeros(quality.STATS), np.ones(quality.STATS))


def statistics(text, declared):
    """The statistics of one document, in plain Python."""
    raw, blanks = text.encode(), b" \t\v\f\r"
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", raw) if w]
    folded = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    stop, loud, sign = b".,;:'\"-()", b"!?", b"#$%&*+/<=>@[\\]^_`{|}~"
    kinds = [
        lambda c: 65 <= c <= 90, lambda c: 97 <= c <= 122, lambda c: 48 <= c <= 57, lambda c: c in blanks, lambda c: c == 10,
        lambda c: c in stop, lambda c: c in loud, lambda c: c in sign, lambda c: c >= 128,
    ]
    n = max(len(words), 1)
    return [sum(map(k, raw)) / max(len(raw), 1) for k in kinds] + [
        sum(map(len, words)) / n / 10,
        len(set(folded)) / n,
        math.log1p(len(words)) / 10,
        raw.count(b"\n") / n,
        sum(65 <= w[0] <= 90 for w in words) / n,
        sum(a == b for a, b in zip(folded, folded[1:])) / n,
        sum(len(w) == 1 and w[0] in sign for w in words) / n,
        math.log1p(max(declared, 0)) / 15,
    ]


def test_inputs_are_those_of_plain_python_and_of_each_document_alone():
    rng = random.Random(4)
    some = ["a", "A", "the", "The", "#", "%", "12", "Ünder!", "x" * 90, "X" * 90, "(so)", "end."]
    texts = ["", " \n\n ", "a", "a a A", "a b"] + ["".join(rng.choice(some) + rng.choice([" ", "\n", "\t "]) for _ in range(rng.randrange(40))) for _ in range(60)]
    texts += ["word " * 200_000, "tail"]  # a chunk of its own
    declared = np.arange(len(texts), dtype=float) - 3
    done = 0
    for a, b, bucket, ends, stats in quality.inputs(pa.array(texts), declared):
        for i in range(a, b):
            assert np.allclose(stats[i - a], statistics(texts[i], declared[i]), atol=1e-12), texts[i][:50]
            ((_, _, alone, _, own),) = quality.inputs(pa.array([texts[i]]), declared[i : i + 1])
            assert (own[0] == stats[i - a]).all() and list(alone) == list(bucket[ends[i - a] : ends[i - a + 1]])
            done += 1
    assert done == len(texts)


def test_linear_time_sum_is_the_sum_over_pairs():
    m, texts = machine(), ["one two Three two!", "", "a b\nc d e f", "ÄÖ 12 34 % &"]
    for a, b, bucket, ends, stats in quality.inputs(pa.array(texts), np.arange(4.0)):
        got = m.score(bucket, ends, stats)
        for i in range(b - a):
            own = bucket[ends[i] : ends[i + 1]]
            x = np.concatenate([np.full(len(own), 1 / np.sqrt(max(len(own), 1))), stats[i]])
            at = np.concatenate([own, quality.BUCKETS + np.arange(quality.STATS)])
            z = m.bias + x @ m.weight[at]
            z += sum(x[p] * x[q] * (m.vector[at[p]] @ m.vector[at[q]]) for p in range(len(x)) for q in range(p))
            assert abs(got[i] - 1 / (1 + np.exp(-np.clip(z, -40, 40)))) < 1e-9


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in quality.query(spark, folder).collect()}
    assert len(got) == read(spark, folder, "documents").count()
    right, scores = [], {0: [], 1: []}
    for r in read(spark, folder, "labels").collect():
        g = got[r["doc_id"]]
        assert g["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        if g["held_out"]:
            right.append(g["predicted"] == r["quality"])
            scores[r["quality"]].append(g["score"])
    assert np.mean(right) >= 0.95
    assert np.mean([a < b for a in scores[0] for b in scores[1]]) >= 0.97


def test_odd_tables(spark, odd, nothing, crowded, folder_of):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)] + [(3, None, 0), (None, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    rows = quality.query(spark, folder_of(documents=odd, labels=labels)).collect()
    assert len(rows) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in rows)
    assert plain(quality.query(spark, folder_of(documents=crowded, labels=labels))) == sorted((tuple(r) for r in rows), key=repr)
    assert plain(quality.query(spark, folder_of(documents=nothing, labels=labels))) == []
    unlabelled = quality.query(spark, folder_of(documents=odd, labels=labels.limit(0))).collect()
    assert len(unlabelled) == len(odd_rows())
    staged = quality.stage(spark, crowded, folder_of(labels=labels))
    assert staged.columns == ["doc_id", "text", "lang", "source", "n_chars"] and staged.count() <= len(odd_rows())
