"""Vector searches against brute force."""

import numpy as np
import pytest
from cases import plain
from compare import compare, duck

from wonted.llm import ann, exact_topk
from wonted.llm.vectors import beside, parts_of

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, n=600, width=16, seed=1):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(6, width))
    v = middle[rng.integers(0, 6, n)] + 0.6 * rng.normal(size=(n, width))
    v[50:250] = v[50]  # one vector in a third of the rows
    rows = [(i, [float(np.float32(x)) for x in row], 0) for i, row in enumerate(v)]
    odd = [(1000, None, 0), (None, rows[0][1], 0), (1020, [None] + rows[0][1][1:], 0), (1040, [float("nan")] * width, 1), (1060, [float("inf")] * width, None), (1100, [0.0] * width, 0), (1200, rows[3][1][:7], 0), rows[4], rows[4], rows[40]]
    return spark.createDataFrame(rows + odd, SCHEMA).repartition(3)


def brute(df, zero, every, k, integer):
    rows = {}
    for r in df.collect():
        e = r["embedding"]
        if r["vec_id"] is None or e is None or any(x is None or not np.isfinite(x) for x in e) or not (zero or any(e)):
            continue
        rows[r["vec_id"]] = max(e, rows.get(r["vec_id"], e))
    ids = np.array(sorted(rows))
    m = np.array([rows[i] + [0.0] * (16 - len(rows[i])) for i in ids], np.float64)
    if integer:
        m = np.floor(1024 * m)
    out = {}
    for i, v in zip(ids, m):
        if i % every == 0:
            s = (m * v).sum(1)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), s[j]) for j in order]
    return out


def of(result):
    out = {}
    for r in sorted(result.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


@pytest.mark.parametrize("block", [8192, 100])
def test_exact_topk(spark, block):
    df = table(spark)
    v = exact_topk.integers(df)
    assert of(exact_topk.search(v, v.filter("vec_id % 20 = 0"), block=block, query_block=7)) == brute(df, True, 20, 10, True)


def test_exact_topk_sql(spark, folder_of):
    folder = "/root/testdata/sf0.001"
    assert compare(exact_topk.query(spark, folder), duck(folder), exact_topk.ORACLE) is None


def test_index_stops_on_proof_only():
    rng = np.random.default_rng(4)
    x = np.floor(300 * rng.normal(size=(2000, 24)))
    index = exact_topk.ImpactIndex(np.arange(2000), x)
    for q in x[:40]:
        ids, scores = index.search(q, -1, 10)
        s = x @ q
        assert list(ids) == list(np.lexsort((np.arange(2000), -s))[:10]) and (scores == s[ids]).all()


def test_queries_of_a_block_share_the_segments():
    """Copies, ties and components of any size: whole blocks of queries equal brute force, the own id left out."""
    rng = np.random.default_rng(8)
    for scale in (3, 300, 1e5, 3e6):  # small scores with many ties, exact and rounded accumulators
        x = np.floor(scale * rng.normal(size=(3000, 24)) * np.linspace(2, 0.1, 24))
        x[100:1100] = x[100]
        ids = rng.permutation(3000).astype(np.int64)
        at, found, scores = exact_topk.ImpactIndex(ids, x).search_all(x[::37], ids[::37], 10)
        for n, place in enumerate(range(0, 3000, 37)):
            s = x @ x[place]
            order = [i for i in np.lexsort((ids, -s)) if i != place][:10]
            assert list(found[at == n]) == list(ids[order]) and list(scores[at == n]) == list(s[order])


def test_short_vectors_are_never_read():
    rng = np.random.default_rng(9)
    x = np.floor(1000 * rng.normal(size=(6000, 16)))
    x[1000:] = np.floor(x[1000:] / 10_000)
    index = exact_topk.ImpactIndex(np.arange(6000), x)
    index.vectors[3000:] = np.nan
    at, found, _ = index.search_all(x[:50], np.arange(50), 10)
    for n in range(50):
        s = x @ x[n]
        assert list(found[at == n]) == [i for i in np.lexsort((np.arange(6000), -s)) if i != n][:10]


def test_shuffled_rows_hold_one_vector(spark):
    """No arrays of vectors in a row, and few copies of the queries: parts grow with the table, up to a bound."""
    v = exact_topk.integers(table(spark))
    assert "collect_list" not in exact_topk.search(v, v.filter("vec_id % 20 = 0"))._jdf.queryExecution().toString()
    assert [parts_of(n, 8192) for n in (0, 8192, 8193, 615_384, 12_000_000, 30_000_000)] == [1, 1, 2, 48, 48, 115]
    got = beside(v, v.filter("vec_id % 20 = 0"), 5).collect()
    assert len(got) == v.count() + 5 * v.filter("vec_id % 20 = 0").count() and {r["part"] for r in got} == set(range(5))


def test_ann_recall_and_exact_scores(spark):
    df = table(spark, 1500)
    vectors = ann.usable(df, zero=False)
    got, want = of(ann.search(vectors, vectors.filter("vec_id % 20 = 0"), block=90, query_block=11)), brute(df, False, 20, 20, False)
    assert got.keys() == want.keys() and all(len(got[i]) == 20 for i in got)
    hits = sum(len({x for x, _ in got[i]} & {x for x, _ in want[i]}) for i in want)
    assert hits >= 0.9 * 20 * len(want)
    exact = {i: dict(w) for i, w in brute(df, False, 20, 10**6, False).items()}
    assert max(abs(s - exact[i][x]) for i in got for x, s in got[i]) < 1e-12  # sums in another order


def test_most_candidates_are_abandoned_where_vectors_have_clusters(spark):
    """The adaptive branch: with the bound of the nearest list, a fifth of the lists finds the neighbours and few are measured in full."""
    rng = np.random.default_rng(12)
    middle = 3 * rng.normal(size=(40, 64))
    v = middle[rng.integers(0, 40, 4000)] + 0.5 * rng.normal(size=(4000, 64))
    turn = np.linalg.qr(rng.normal(size=(64, 64)))[0]
    q, told = v[:50] @ turn, {}
    exact = ann.distances(v[:50], v)
    bound = np.sort(exact, axis=1)[:, 25]  # as if the nearest list had been measured
    barred = np.zeros((50, 4000), bool)
    i, j = ann.scan(q, v @ turn, barred, 20, bound, told=told)
    want = {(x, y) for x in range(50) for y in np.argsort(exact[x], kind="stable")[:20]}
    assert len(want & set(zip(i, j))) >= 0.99 * len(want)
    assert told["abandoned"] > 0.9 * told["pairs"] and told["components"] < 0.5 * told["pairs"] * 64
    df = spark.createDataFrame([(n, [float(x) for x in r], 0) for n, r in enumerate(v)], SCHEMA).repartition(3)
    vectors = ann.usable(df, zero=False)
    got = of(ann.search(vectors, vectors.filter("vec_id % 100 = 0"), share=0.2))
    products = {x: sorted(((-(np.float32(v[x]).astype(float) * np.float32(v[y]).astype(float)).sum(), y) for y in range(4000) if y != x))[:20] for x in got}
    hits = sum(len({y for y, _ in got[x]} & {y for _, y in products[x]}) for x in got)
    assert hits >= 0.9 * 20 * len(got)


def test_few_vectors_and_clashing_columns(spark):
    df = table(spark, 1500).filter("vec_id in (0, 20, 31, 40, 1020, 1100)").selectExpr("*", "1 rank", "2 score", "'x' v", "'y' list")
    v = ann.usable(df, zero=False)
    assert {i: [x for x, _ in w] for i, w in of(ann.search(v, v.filter("vec_id % 20 = 0"))).items()} == {
        i: [x for x, _ in w] for i, w in brute(df, False, 20, 20, False).items()
    }
    z = exact_topk.integers(df)
    assert of(exact_topk.search(z, z.filter("vec_id % 20 = 0"))) == brute(df, True, 20, 10, True)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    v = ann.usable(none, zero=False)
    assert plain(ann.search(v, v)) == [] and plain(exact_topk.search(exact_topk.integers(none), exact_topk.integers(none))) == []
