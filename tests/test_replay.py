"""The declarative replay against brute force, and independence from the physical plan."""

import pytest
from brute import Mailbox
from mailboxes import frame, random_mailbox

from wonted.config import SkewPolicy
from wonted.plans.rebuild import replay
from wonted.sources.facts import prepare

TINY = SkewPolicy(hot_rows=8, chunk_rows=3, id_block=4)


def merged(seeds, **kw):
    """Several mailboxes in one table, told apart by their addresses and threads."""
    rows, expected = [], {}
    for s in seeds:
        box = random_mailbox(s, **kw)
        for m in box:
            m["msg_id"] += s * 1000
        expected[s] = box
        rows += box
    return rows, expected


def result(derived):
    scored = derived.scored.select(
        "msg_id", "tier", "p_n", "anomaly_score", *[c for c in derived.scored.columns if c.startswith("raw_")]
    ).collect()
    return {
        r["msg_id"]: (
            r["tier"], r["p_n"],
            {k[4:]: v for k, v in r.asDict().items() if k.startswith("raw_") and v is not None},
        )
        for r in scored
    }


def same(got, want):
    assert got.keys() == want.keys()
    for k, (tier, n, raws) in want.items():
        assert got[k][:2] == (tier, n), k
        assert got[k][2].keys() == raws.keys(), (k, got[k][2], raws)
        for f, v in raws.items():
            assert got[k][2][f] == pytest.approx(v, abs=1.01e-4), (k, f)


@pytest.mark.parametrize("seed,policy", [(0, SkewPolicy()), (2, SkewPolicy()), (3, TINY)], ids=["a", "b", "split"])
def test_replay_matches_brute_force(spark, seed, policy):
    rows = random_mailbox(seed)
    derived = replay(prepare(frame(spark, rows)), policy=policy)
    box = Mailbox(rows)
    same(result(derived), box.judged())
    tiers = {r["sender"]: r["trust_tier"] for r in derived.tiers().collect()}
    assert tiers == box.final_tiers()
    credits = {(r["thread_id"], r["sender"]): r["kind"] for r in derived.credits.collect()}
    assert credits == {k: kind for k, (_, kind) in box.credits.items()}


def test_score_is_the_capped_sum_of_features(spark):
    derived = replay(prepare(frame(spark, random_mailbox(7))))
    sums = {}
    for f in derived.features.collect():
        sums[f["msg_id"]] = sums.get(f["msg_id"], 0) + f["contribution"]
    scores = {r["msg_id"]: r["anomaly_score"] for r in derived.scores.collect()}
    assert any(sums.values())
    for k, v in scores.items():
        assert v == pytest.approx(min(100, sums.get(k, 0)), abs=1e-6)


def test_plan_does_not_change_the_result(spark):
    rows = random_mailbox(11)
    first = result(replay(prepare(frame(spark, rows))))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        again = result(replay(prepare(frame(spark, rows[::-1])), policy=TINY))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert first == again
