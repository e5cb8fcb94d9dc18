"""Repeated byte strings against plain Python."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from cases import SCHEMA, odd_rows, plain

from wonted.llm import substring_dedup as sd


def brute(rows, length=400):
    raw = [(r[1] or "").encode() for r in rows]
    seen = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for r, t in zip(rows, raw):
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1)
        out.append((r[0], len(t), int(gone.sum()), len(edges), bytes(b for b, g in zip(t, gone) if not g)))
    return sorted(out, key=repr)


def rows_with_passages(seed=1):
    rng = random.Random(seed)
    fresh = lambda n: "".join(rng.choice("abcde éñ\n") for _ in range(n))
    passage, other = fresh(700), fresh(450)
    texts = [fresh(rng.randrange(0, 1500)) for _ in range(25)]
    texts += [fresh(rng.randrange(300)) + passage[rng.randrange(200) :] + fresh(rng.randrange(300)) for _ in range(25)]
    texts += [fresh(200) + other + fresh(100) + other + fresh(50)] + [fresh(100) + passage + other]
    base = fresh(3000)
    for _ in range(12):  # near copies
        i = rng.randrange(len(base))
        texts.append(base[:i] + "X" + base[i + rng.randrange(3) :])
    texts += [texts[3]] * 3 + [base] * 4
    texts += ["a" * 1000, "a" * 399, "a" * 400, "a" * 401, "z" * 500 + "a" * 500 + "z" * 500, "ab" * 600, "\x00" * 900 + "x", "y" + "\x00" * 450, "é" * 300, "zyx" * 200 + "a"]
    texts += ["q" * 399 + "r", "q" * 400, "", None]
    rng.shuffle(texts)
    return [(i, t, "en", "s", 1) for i, t in enumerate(texts)]


def of(df, **kw):
    return plain(sd.cut_out(df, sd.spans(df, **kw)))


@pytest.mark.parametrize("wide", [4096, 5])
def test_all_strings_that_repeat(spark, wide):
    rows = rows_with_passages()
    assert of(spark.createDataFrame(rows, SCHEMA).repartition(4), wide=wide) == brute(rows)


def test_suffix_order_is_the_order_of_the_strings():
    rng = np.random.default_rng(8)
    for trial in range(60):
        contexts = []
        for _ in range(rng.integers(1, 12)):
            c = rng.integers(97, 97 + rng.integers(1, 5), rng.integers(40, 90)).astype(np.uint8)
            contexts.append(bytes(c) if rng.random() < 0.6 or not contexts else contexts[rng.integers(len(contexts))][: rng.integers(40, 90)] + bytes(c)[:20])
        length = 40
        text = np.frombuffer(b"".join(contexts), np.uint8)
        ends = np.cumsum([len(c) for c in contexts])
        wanted = np.zeros(len(text), bool)
        for e, c in zip(ends, contexts):
            wanted[e - len(c) : e - length + 1] = True
        equal = np.array([hash(text[i : i + length].tobytes()) & (2**63 - 1) for i in range(len(text))], np.uint64)
        order = sd.suffix_order(text, ends, wanted, equal, length)
        assert sorted(order) == list(np.flatnonzero(wanted))
        strings = [text[i : i + length].tobytes() for i in order]
        assert strings == sorted(strings)
        assert list(sd.common_prefixes(order, text, length)) == [a == b for a, b in zip(strings, strings[1:])]


def test_long_documents_are_anchored_in_slices(spark, monkeypatch):
    rng = random.Random(9)
    whole = "".join(rng.choice("abc") for _ in range(6000))
    rows = [(1, whole, "en", "s", 1), (2, whole[2500:4500], "en", "s", 1), (3, whole[100:300] + whole[5000:], "en", "s", 1)]
    raw = whole.encode()
    owned = []
    for size in (500, 100_000):
        windows = {}
        for x in range(0, len(raw), size):
            y = min(x + size + 399, len(raw))
            _, at, n, gram, _ = sd.anchors(np.frombuffer(raw[x:y], np.uint8), np.array([0, y - x]), 400)
            for a, k, g in zip(at, n, gram):
                windows |= {x + a + i: g for i in range(k)}
        owned.append(windows)
    assert owned[0] == owned[1] and len(owned[0]) == len(raw) - 399
    assert of(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_odd_tables(spark, odd, nothing, crowded, folder_of):
    rows = [r for r in odd_rows() if len(r[1] or "") < 20_000]
    want = brute(rows)
    small = odd.filter("text is null or length(text) < 20000")
    assert of(small) == want and of(crowded.filter("text is null or length(text) < 20000")) == want
    assert of(nothing) == []
    got = plain(sd.query(spark, folder_of(documents=small)))
    assert got == sorted(((i, n, r, s, hashlib.sha256(k).hexdigest(), k.decode("utf-8", "replace")) for i, n, r, s, k in want), key=repr)


def test_whole_table_equals_all_windows_counted(spark):
    """Every window of every text of a table, counted by Python's own hash of its bytes."""
    folder, length = "/root/testdata/sf0.01", 400
    docs = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    raw = [(d["text"] or "").encode() for d in docs]
    hashes = [np.array([hash(t[i : i + length]) for i in range(len(t) - length + 1)], np.int64) for t in raw]
    values, times = np.unique(np.concatenate(hashes), return_counts=True)
    often = values[times > 1]
    want = []
    for d, t, h in zip(docs, raw, hashes):
        cover = np.zeros(len(t) + 1, np.int64)
        at = np.flatnonzero(np.isin(h, often))
        np.add.at(cover, at, 1)
        np.add.at(cover, at + length, -1)
        gone = np.cumsum(cover)[: len(t)] > 0
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1)
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        want.append((d["doc_id"], len(t), int(gone.sum()), len(edges), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")))
    got = plain(sd.query(spark, folder))
    assert got == sorted(want, key=repr) and sum(r[2] > 0 for r in got) > 100
