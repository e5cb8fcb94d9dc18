"""Hard negatives against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from cases import CLASHING, plain
from compare import compare, duck
from pyspark.sql import functions as F

from wonted.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int"


def rows(n=400, width=8, seed=2, scale=1.0):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(4, width))
    kind = rng.integers(0, 4, n)
    v = (middle[kind] + 0.7 * rng.normal(size=(n, width))) * scale
    v[n // 4 : n // 4 + n // 3] = v[n // 4]  # one vector in a third of the rows: ties everywhere
    out = [(i, [float(x) for x in e], int(k)) for i, (e, k) in enumerate(zip(v, kind))]
    some = out[0][1]
    out += [(500, None, 1), (550, [None] + some[1:], 1), (600, [float("nan")] * width, 1), (650, [float("inf")] * width, 1), (700, some, None), (None, some, 1)]
    return out + [(750, [0.0] * width, 2), (800, some[:3], 0), (-50, some, 3), out[50], out[50], out[3], (900, some, 99)]


def brute(table, every=50, positives=5, negatives=3, low=50, high=95):
    kept = {}
    for i, e, label in table:
        if i is None or e is None or label is None or any(x is None or not np.isfinite(x) for x in e):
            continue
        kept[i] = max((e, label), kept.get(i, (e, label)))
    whole = {i: ([int(np.floor(256 * x)) for x in e], (label + 1) % 10 if i % 7 == 0 else label) for i, (e, label) in kept.items()}
    out = []
    for a, (q, label) in whole.items():
        if a % every:
            continue
        scored = sorted((-max(-hn.MOST, min(hn.MOST, sum(x * y for x, y in zip(q, e)))), i, other) for i, (e, other) in whole.items() if i != a)
        for score, p, _ in [x for x in scored if x[2] == label][:positives]:
            fit = [x for x in scored if x[2] != label and low * -score <= 100 * -x[0] <= high * -score]
            out += [(a, p, r + 1, i, -score, -s) for r, (s, i, _) in enumerate(fit[:negatives])]
    return sorted(out)


def mined(df, **how):
    v = hn.usable(df)
    v = v.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return plain(hn.mine(v, v.filter("vec_id % 50 = 0"), **how))


@pytest.mark.parametrize("block", [4096, 60])
def test_equals_brute_force(spark, block):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(5)
    got = mined(df, block=block, anchor_block=3 if block < 100 else 512)
    assert got == sorted(brute(rows()), key=repr) and len(got) > 50


def test_large_components_are_exact(spark):
    table = rows(120, seed=5, scale=3e7)
    assert mined(spark.createDataFrame(table, SCHEMA), block=50) == sorted(brute(table), key=repr)
    huge = rows(60, seed=6, scale=1e30)
    assert mined(spark.createDataFrame(huge, SCHEMA)) == sorted(brute(huge), key=repr)


def test_positives_multiply_their_own_label_only(spark, monkeypatch):
    rng = np.random.default_rng(7)
    labels, v, done = rng.integers(0, 10, 5000), np.floor(100 * rng.normal(size=(5000, 8))), []
    monkeypatch.setattr(hn, "products", lambda q, v, f=hn.products: (done.append(len(q) * len(v)), f(q, v))[1])
    held = hn.Part(np.arange(5000), labels, v).positives(np.arange(200), labels[:200], v[:200], 5)
    assert sum(done) == sum((labels == x).sum() for x in labels[:200])
    for n in range(200):
        s = np.where(labels == labels[n], v @ v[n], -np.inf)
        assert list(held.ids[held.keys == n]) == [i for i in np.lexsort((np.arange(5000), -s)) if i != n][:5]


def test_many_windows_of_a_block_at_once():
    rng = np.random.default_rng(10)
    labels, v = rng.integers(0, 3, 4000), np.floor(40 * rng.normal(size=(4000, 8)))
    v[500:900] = v[500]
    positives = [sorted(int(x) for x in rng.integers(-2000, 20_000, rng.integers(1, 6))) for _ in range(100)]
    held = hn.Part(np.arange(4000), labels, v).negatives(labels[:100], v[:100], hn.bounds(pa.array(positives), 5, 50, 95), 3)
    for n in range(100):
        s = v @ v[n]
        for place, positive in enumerate(positives[n]):
            fit = [i for i in np.lexsort((np.arange(4000), -s)) if labels[i] != labels[n] and 50 * positive <= 100 * s[i] <= 95 * positive]
            assert list(held.ids[held.keys == n * 5 + place]) == fit[:3]


def test_windows_beyond_64_bits():
    got = hn.bounds(pa.array([[hn.MOST, -hn.MOST], [0]]), 2, 50, 95)
    assert got[0].tolist() == [[-(-50 * hn.MOST // 100), -(50 * hn.MOST // 100)], [95 * hn.MOST // 100, -95 * hn.MOST // 100]]
    assert got[1, :, 0].tolist() == [0, 0]
    assert got[1, 0, 1] > got[1, 1, 1]
    over = hn.bounds(pa.array([[hn.MOST]]), 1, 150, 300)  # no score is that high
    assert over[0, 0, 0] > over[0, 1, 0]


def test_shuffled_rows_hold_one_vector(spark):
    v = hn.usable(spark.createDataFrame(rows(), SCHEMA))
    assert "collect_list(struct(vec_id" not in hn.mine(v, v.filter("vec_id % 50 = 0"))._jdf.queryExecution().toString()


def test_windows_of_zero_and_negative_scores():
    assert hn.window(0, 50, 95) == (0, 0)
    least, most = hn.window(-100, 50, 95)
    assert least > most
    for p in range(1, 300):
        least, most = hn.window(p, 50, 95)
        assert [n for n in range(-400, 400) if 50 * p <= 100 * n <= 95 * p] == list(range(least, most + 1))


def test_sql_empty_and_clashing(spark, folder_of):
    folder = "/root/testdata/sf0.001"
    assert compare(hn.query(spark, folder), duck(folder), hn.ORACLE) is None
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    df = spark.createDataFrame(rows(), SCHEMA).select("*", *[F.lit("other").alias(c) for c in CLASHING if c != "label"])
    assert mined(df) == sorted(brute(rows()), key=repr)
    alone = spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 2)], SCHEMA)  # no positive, then no negative
    assert mined(alone) == [] and mined(spark.createDataFrame([(0, [1.0], 1), (50, [1.0], 1)], SCHEMA)) == []
