"""Sketches, likelihood and components; the operator against all pairs."""

import random
from collections import defaultdict

import numpy as np
import pytest
from cases import SCHEMA, odd_rows, plain

from wonted.llm import hashing, near_dup


def word_set(text, k=5):
    w = bytes(text or "", "utf8").lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def brute(rows, percent=85):
    sets = [word_set(t) for _, t, *_ in rows]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if None in (rows[i][0], rows[j][0]) or not a or not b:
                continue
            if 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(rows[i][0]), find(rows[j][0])))
                root[y] = x
    return [(r[0], len(s), find(r[0]) if s and r[0] is not None else r[0]) for r, s in zip(rows, sets)]


def mutated(rng, base, changes):
    w = base.split()
    for _ in range(changes):
        w[rng.randrange(len(w))] = f"w{rng.randrange(10**6)}"
    return " ".join(w)


def grouped_rows():
    rng = random.Random(11)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    rows = []
    for g in range(12):
        base = fresh(rng.choice([30, 120, 400]))
        rows += [base] * (g % 3) + [mutated(rng, base, rng.randrange(0, 1 + len(base.split()) // 25)) for _ in range(3 + 10 * (g == 4))]
    base = fresh(300)
    rows += [mutated(rng, base, 4) for _ in range(120)]  # one large group
    shared = fresh(200)
    rows += [f"{fresh(60)} {shared} {fresh(60)}" for _ in range(60)]  # a passage in common, not near
    rows += [fresh(n) for n in (1, 2, 3, 4, 5, 6)] + ["a b c", "A  b\tC", "a b c d", "", "  \n"]
    rng.shuffle(rows)
    return [(i * 7 % 1009, t, "en", "s", 1) for i, t in enumerate(rows)]


def test_words_and_shingles():
    rng = random.Random(1)
    docs = ["", " ", "One two\tone", "é É x\x0by", "a b c d e", "a b c d e f a b c d e"] + [" ".join(rng.choice("abcd") for _ in range(rng.randrange(20))) for _ in range(50)]
    raw = [d.encode() for d in docs]
    off = np.cumsum([0, *map(len, raw)])
    h, a, b, first = hashing.words(np.frombuffer(b"".join(raw), np.uint8), off)
    seen = {}
    for i, r in enumerate(raw):
        got = [b"".join(raw)[x:y].lower() for x, y in zip(a[first[i] : first[i + 1]], b[first[i] : first[i + 1]])]
        assert got == r.lower().split()
        for w, x in zip(got, h[first[i] : first[i + 1]]):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
    for d, s in zip(docs, hashing.shingles(h, first, 5)):
        assert len(s) == len(word_set(d))


def test_long_words_that_polynomials_take_for_equal():
    """Thue-Morse words: their polynomials modulo 2^64 are equal for every odd base."""
    bits = [bin(i).count("1") % 2 for i in range(4096)]
    x, y = bytes(97 + i for i in bits), bytes(98 - i for i in bits)
    c = hashing.running(np.frombuffer(x + y, np.uint8), hashing.FOLDED_VALUES)
    assert (c[4096] - c[0]) == (c[8192] - c[4096]) * hashing.powers(4097)[1][4096]
    raw = x + b" " + y + b" " + x.upper() + b" " + y[:65] + b" " + x[:64]
    h, a, b, _ = hashing.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert len(h) == 5 and h[0] != h[1] and h[0] == h[2] and len(set(h.tolist())) == 4


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(3)
    for j in (0.3, 0.6, 0.85, 0.95):
        wins, larger, equal = 0, 0, 0
        for _ in range(30):
            n = 500
            common = round(2 * n * j / (1 + j))
            x = rng.integers(0, 2**63, 2 * n - common, dtype=np.uint64) * np.uint64(2)
            a, b = x[:n], x[n - common :]
            r = near_dup.registers(np.concatenate([a, b, x]), np.array([0, len(a), len(a) + len(b)]))
            assert (near_dup.merged(r[0], r[1]) == r[2]).all()
            larger, equal = (r[0] > r[1]).sum(), (r[0] == r[1]).sum()
            grid = np.linspace(0, 1, 201)
            ll = near_dup.log_likelihood(grid, larger, 120 - larger - equal, equal, float(n), float(n))
            wins += abs(grid[ll.argmax()] - j) < 0.16
            if j >= 0.85:
                assert near_dup.not_refuted([larger], [120 - larger - equal], [equal], [n], [n], 85)[0]
        assert wins >= 27


def result(df, **kw):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(df, **kw).collect()), key=repr)


@pytest.mark.parametrize("percent", [85, 80])
def test_components_equal_all_pairs(spark, percent):
    rows = grouped_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert result(df, percent=percent) == sorted(brute(rows, percent), key=repr)


def test_odd_tables(spark, odd, nothing, crowded, folder_of):
    want = sorted(brute(odd_rows()), key=repr)
    assert result(odd) == want and result(crowded) == want
    assert result(nothing) == []
    rows = near_dup.query(spark, folder_of(documents=odd)).collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_stage_keeps_one_of_each(spark):
    rows = grouped_rows()
    kept = sorted(r["doc_id"] for r in near_dup.stage(spark, spark.createDataFrame(rows, SCHEMA), "").collect())
    assert kept == sorted({c for _, _, c in brute(rows, 80)})


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(200, 260)]
    got = dict(plain(near_dup.components(spark.createDataFrame(links, "a long, b long"))))
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in range(200, 260)} == {100}
    assert len(defaultdict(int, got)) == 122
