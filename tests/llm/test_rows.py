"""Sharding, line dedup, mixing and packing against plain Python."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import odd_rows, plain

from wonted.llm import line_dedup, mixing, packing, sharding

BLANK = " \t\n\x0b\x0c\r"


# ---- sharding ------------------------------------------------------------------------------------


def shards_of(df, n=16):
    return plain(sharding.byte_shards(sharding.sizes(df), n, 5))


def test_shards_are_contiguous_and_balanced(odd):
    rows = [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in odd_rows()]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[1]))
    total, at, slots, want = sum(r[1] for r in rows), 0, Counter(), []
    for i, size, crc in rows:
        shard = (2 * at + size) * 16 // (2 * total)
        want.append((i, crc, size, shard, slots[shard]))
        slots[shard] += 1
        at += size
    assert shards_of(odd) == sorted(want, key=repr)


def test_shards_odd_tables(nothing, crowded, odd):
    assert shards_of(nothing) == []
    assert shards_of(crowded) == shards_of(odd)


# ---- line dedup ----------------------------------------------------------------------------------


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute_lines(rows):
    holders = defaultdict(set)
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            key = lower(line.strip(BLANK))
            if len(key) >= 20:
                holders[key].add(i)
    out = []
    for i, t, *_ in rows:
        lines, kept = (t or "").split("\n"), []
        for line in lines:
            ids = holders.get(lower(line.strip(BLANK)), ())
            if len(ids) < 3 or i == max((x for x in ids if x is not None), default=None):
                kept.append(line)
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def lines_of(df, parts=5):
    return line_dedup.without_struck(df, line_dedup.keep_bitmaps(df, parts=parts))


@pytest.mark.parametrize("parts", [1, 7])
def test_line_dedup(odd, parts):
    assert plain(lines_of(odd, parts)) == sorted(brute_lines(odd_rows()), key=repr)


def test_line_dedup_hash_columns_and_long_documents(spark, folder_of):
    rows = [(i, "\n".join([f"line number {j} of a long document" for j in range(i, 300)]), "en", "s", 1) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in line_dedup.query(spark, folder_of(documents=df)).collect()}
    for i, n, dropped, kept in brute_lines(rows):
        assert (got[i]["n_lines"], got[i]["n_dropped"], got[i]["kept_sha256"]) == (n, dropped, hashlib.sha256(kept.encode()).hexdigest())
    stage = {r["doc_id"]: r for r in line_dedup.stage(spark, df, "").collect()}
    assert stage[0]["n_chars"] == len(stage[0]["text"]) and len(stage) == 6


def test_line_keys_are_trimmed_only_where_there_is_something_to_trim(spark):
    bare = "Éa Line Of 20 Letters"
    texts = [f"{a}{bare}{b}" for a in ["", *" \t\x0b\x0c\r", "\u00a0"] for b in ["", *" \t\x0b\x0c\r", "\u00a0", " \t\r"]]
    texts += [" " * 30, "x" * 19 + " ", " " + "x" * 20, "x" * 20, "", "é" * 20 + "\t", "\n".join([bare, " " + bare, ""]), None]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert plain(lines_of(df)) == sorted(brute_lines(rows), key=repr)
    keys = {(r["doc_id"], r["pos"]): (r["h1"], r["h2"]) for r in line_dedup.occurrences(df).collect()}
    stripped = {(i, k): lower(line.strip(BLANK)) for i, t, *_ in rows for k, line in enumerate((t or "").split("\n"))}
    long = {at: key for at, key in stripped.items() if len(key) >= 20}
    assert keys.keys() == long.keys() and len(set(keys.values())) == len({(keys[at], long[at]) for at in long}) == len(set(long.values()))
    plan = line_dedup.occurrences(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("trim(") == plan.count("THEN trim(") > 0


def test_line_dedup_odd_tables(nothing, crowded, odd):
    assert plain(lines_of(nothing)) == []
    assert plain(lines_of(crowded)) == plain(lines_of(odd))


# ---- mixing --------------------------------------------------------------------------------------


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, free, rest = {}, set(names), share * sum(sizes.values())
    while True:
        level = rest / sum(w[s] for s in free) if free else 0
        over = [s for s in free if w[s] * level > cap * sizes[s]]
        if not over:
            return target | {s: w[s] * level for s in free}
        for s in over:
            target[s] = cap * sizes[s]
            rest -= target[s]
            free.discard(s)


def mix(df, **kw):
    sized = mixing.sizes(df)
    return mixing.copies(sized, mixing.targets(sized), **kw)


def test_mix_targets(odd):
    sizes = Counter()
    for _, t, _, s, _ in odd_rows():
        sizes[s] += len((t or "").encode().split())
    got = {r["source"]: r["target"] for r in mixing.targets(mixing.sizes(odd)).collect()}
    assert got == pytest.approx(brute_targets(dict(sizes)))


@pytest.mark.parametrize("group_rows", [20_000, 3])
def test_mix_takes_near_target(spark, group_rows):
    rows = [(i, "word " * (1 + i * 7 % 50), "en", f"s{i % 5}" if i % 3 else "hot", 1) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    got = mix(df, group_rows=group_rows, fan_in=4).collect()
    plan = {r["sid"]: r for r in mixing.targets(mixing.sizes(df)).collect()}
    assert len(got) == len(rows) and {r["copies"] for r in got} <= {0, 1, 2}
    taken = Counter()
    for r in got:
        taken[r["sid"]] += r["copies"] * r["size"]
    for sid, p in plan.items():
        assert abs(taken[sid] - p["target"]) <= 60
    again = mix(df.repartition(2), group_rows=group_rows, fan_in=4)
    assert plain(again) == sorted((tuple(r) for r in got), key=repr)


def test_pivot_keeps_expectation():
    rng = np.random.default_rng(5)
    p = np.array([0.3, 0.3, 0.7, 0.2, 0.9, 0.1])
    mean = np.zeros(len(p))
    for _ in range(20_000):
        out = mixing.pivot(p, rng.random(len(p)))
        assert abs(out.sum() - p.sum()) < 1e-9 and ((out > 1e-9) & (out < 1 - 1e-9)).sum() <= 1
        mean += out / 20_000
    assert np.abs(mean - p).max() < 0.02


def test_mix_odd_tables(spark, nothing, crowded, odd):
    assert plain(mix(nothing)) == []
    assert plain(mix(crowded)) == plain(mix(odd))
    assert len(plain(mix(odd))) == len(odd_rows())
    staged = Counter(r["doc_id"] for r in mixing.stage(spark, odd, "").collect())
    want = Counter()
    for r in mix(odd).collect():
        want[r["doc_id"]] += r["copies"]
    assert staged == +want


# ---- packing -------------------------------------------------------------------------------------


def check_packing(rows, pieces, capacity):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary() + ".json")
    want = Counter()
    for i, t, *_ in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for a in range(0, len(ids), capacity):
            cut = ids[a : a + capacity]
            want[i, a, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes()), len(ids)] += 1
    assert Counter(tuple(r)[:5] for r in pieces) == want
    held = defaultdict(list)
    for r in pieces:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(held) == list(range(len(held)))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held), sum(r["length"] for r in pieces)


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packing(odd, capacity):
    got = packing.packed(packing.pieces(odd, capacity), capacity, salt_rows=4).collect()
    n, tokens = check_packing(odd_rows(), got, capacity)
    assert n <= tokens / capacity + 2


def test_packing_of_a_whole_table(spark):
    """All ids are those of the tokenizer that the vocabulary's file describes, and padding is small."""
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    n, tokens = check_packing(rows, packing.query(spark, folder).collect(), 2048)
    assert n * 2048 <= tokens * 1.01 + 2048


def test_packing_special_token_and_rare_characters(spark):
    rows = [(1, "a <|endoftext|> b", "en", "s", 1), (2, "\x1c\x1d tab em \U0001f600 你好  \x85x", "en", "s", 1), (3, "a" * 9000, "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    check_packing(rows, packing.packed(packing.pieces(df)).collect(), 2048)


def test_fullest_against_all_subsets():
    rng = np.random.default_rng(2)
    for _ in range(200):
        counts = {int(x): int(rng.integers(1, 4)) for x in rng.integers(1, 30, 5)}
        room = int(rng.integers(0, 60))
        sums = {0}
        for x, n in counts.items():
            sums = {s + x * k for s in sums for k in range(n + 1) if s + x * k <= room}
        chosen = packing.fullest(counts, room)
        assert sum(x * n for x, n in chosen.items()) == max(sums)
        assert all(n <= counts[x] for x, n in chosen.items())


def test_packing_odd_tables(nothing, crowded, odd):
    assert plain(packing.packed(packing.pieces(nothing))) == []
    assert plain(packing.packed(packing.pieces(crowded))) == plain(packing.packed(packing.pieces(odd)))
