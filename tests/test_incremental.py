"""Arrival order in batches against brute force, repeated batches, and equality with a replay."""

import time

import pyarrow.parquet as pq
import pytest
from brute import Mailbox
from mailboxes import frame, random_mailbox
from pyspark.sql import types as T
from test_ingest import COLUMNS, row
from test_replay import TINY, same

from wonted.config import SkewPolicy
from wonted.functions.position import id_of
from wonted.operators.arrival import arrival_credits
from wonted.operators.skew import find_hot_keys
from wonted.plans.rebuild import replay
from wonted.sources import facts
from wonted.sources.facts import prepare
from wonted.streaming.incremental import (
    KEY,
    arrived_facts,
    current_messages,
    file_stream,
    follow_generations,
    late_senders,
    rebuild_store,
    released_rows,
    replay_store,
    score_batch,
    score_landed_batch,
    score_stream,
)
from wonted.streaming.store import Store


def stored(store):
    raws = {}
    for f in store.rows("message_score_features").collect():
        raws.setdefault(f["msg_id"], {})[f["feature"]] = f["raw_value"]
    return {
        r["msg_id"]: (r["trust_tier_at_scoring"], r["baseline_n"], raws.get(r["msg_id"], {}))
        for r in store.rows("message_scores").collect()
    }


def run(spark, folder, rows, cuts, policy=SkewPolicy()):
    store = Store(spark, str(folder))
    edges = [0, *cuts, len(rows)]
    for b, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
        score_batch(frame(spark, rows[lo:hi]), store, b, policy=policy)
    return store


@pytest.mark.parametrize("seed,policy", [(21, SkewPolicy()), (22, TINY)], ids=["plain", "split"])
def test_batches_match_brute_force_in_arrival_order(spark, tmp_path, seed, policy):
    rows = random_mailbox(seed, n=70, undated=False)
    store = run(spark, tmp_path / "s", rows, [25, 50], policy)
    same(stored(store), Mailbox(rows, arrival=True).judged())
    late = {r["sender"] for r in late_senders(store).collect()}
    want, top = set(), {}
    for m in rows:
        s = m["from_email_norm"]
        if m["direction"] == "in":
            if m["sent_at"] < top.get(s, 0):
                want.add(s)
            top[s] = max(top.get(s, 0), m["sent_at"])
    assert late == want and want
    scores = replay_store(store).scores.select("msg_id", "anomaly_score").collect()
    fresh = replay(prepare(frame(spark, rows))).scores.select("msg_id", "anomaly_score").collect()
    assert sorted(map(tuple, scores)) == sorted(map(tuple, fresh))


def test_in_order_batches_equal_replay_and_repeat_cleanly(spark, tmp_path):
    rows = random_mailbox(31, n=60, undated=False, in_order=True)
    store = run(spark, tmp_path / "s", rows, [30])
    derived = replay(prepare(frame(spark, rows)))
    first = {r["msg_id"]: r["anomaly_score"] for r in store.rows("message_scores").collect()}
    assert first == {r["msg_id"]: r["anomaly_score"] for r in derived.scores.collect()}
    # the same batch again (as after a failure), with the rows it had
    score_batch(frame(spark, rows[30:]), store, 1)
    again = {r["msg_id"]: r["anomaly_score"] for r in store.rows("message_scores").collect()}
    assert again == first
    # rows already stored are not taken twice by a later batch
    score_batch(frame(spark, rows[:40]), store, 2)
    assert store.rows("messages").count() == len(rows)


@pytest.mark.parametrize("policy", [SkewPolicy(), TINY], ids=["plain", "split"])
def test_arrival_credits_with_very_late_rows(spark, policy):
    for seed in (41, 42):
        rows = random_mailbox(seed, n=150, undated=False)
        for i, m in enumerate(rows):  # few threads, many outgoing, times all mixed up
            m["thread_id"] = i % 2
            m["sent_at"] = (i * 7919) % 151
            if m["direction"] == "in" and i % 3 == 0:
                m |= {"direction": "out", "recipients": [m["from_email_norm"]], "from_email_norm": "me@homestead.com"}
        p = prepare(frame(spark, rows), order_by="msg_id")
        hot = find_hot_keys(p, ["thread_id"], "msg_id", "msg_id", policy)
        got = arrival_credits(facts.incoming(p), facts.outgoing(p), hot=hot, policy=policy)
        got = got.selectExpr("thread_id", "sender", "kind", f"{id_of('pos')} AS at").collect()
        box = Mailbox(rows, arrival=True)
        want = {k: (kind, box.seq[i]["msg_id"]) for k, (i, kind) in box.credits.items()}
        assert {(r["thread_id"], r["sender"]): (r["kind"], r["at"]) for r in got} == want




def landed_mail(uid, folder="INBOX", generation=1, served=True, deleted=False, role="inbox", sender=None, msg_id=None):
    sender = f"p{uid % 3}@north-ford.com" if sender is None else sender
    return row(uid, sender, folder, role, generation, served=served)[:5] + (msg_id or uid,) + row(uid, sender)[6:18] + (served, deleted)


def land_files(spark, folder, *files):
    for f in files:
        spark.createDataFrame(list(f), COLUMNS + ", deleted boolean").coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(1.1)  # the source takes files by time of change


def stream(spark, tmp_path, mine):
    schema = T.StructType.fromDDL(COLUMNS + ", deleted boolean")
    source = file_stream(spark, str(tmp_path / "landed"), schema, files_per_batch=1)
    score_stream(source, str(tmp_path / "store"), str(tmp_path / "offsets"), mine=mine).awaitTermination()
    store = Store(spark, str(tmp_path / "store"))
    return store, sorted((r["folder"], r["generation"], r["uid"]) for r in current_messages(store).collect())


@pytest.fixture
def mine(spark):
    return spark.createDataFrame([(1, "me@x.org")], "account_id bigint, email_norm string")


def test_gaps_are_held_back_until_filled(spark, tmp_path, mine):
    """Interleaved ids, gaps that are filled or deleted, rows listed again, older generations."""
    m, got = landed_mail, set()
    schema = COLUMNS + ", deleted boolean"

    def step(batch, *rows):
        arrived = arrived_facts(spark.createDataFrame(list(rows), schema), mine)
        store = follow_generations(arrived, Store(spark, str(tmp_path / "s"), batch), batch)
        released = released_rows(arrived, store, batch).cache()
        keys = {(r["folder"], r["generation"], r["uid"]) for r in released.collect()}
        assert not keys & got  # nothing twice
        store.write("passed", released.select(*KEY), batch)
        store.write("marks", released.groupBy(*KEY[:3]).agg({"uid": "max"}).withColumnRenamed("max(uid)", "last_seen_uid"), batch)
        got.update(keys)
        return sorted(keys)

    inbox = lambda *uids, g=1: [("INBOX", g, u) for u in uids]
    assert step(0, m(1), m(3), m(5), m(9, served=False), m(10), m(20, "Odd", role="strange")) == inbox(1, 3, 5)
    assert step(1, m(2), m(4), m(3), m(12), m(30, "Old")) == inbox(2, 4) + [("Old", 1, 30)]  # nothing behind the gap
    # a served row stays served, also when a later listing misses it; 13 is a new gap
    assert step(2, m(9), m(10, served=False), m(13, served=False), m(14)) == inbox(9, 10, 12)
    assert step(3, m(9, served=False), m(13, deleted=True), m(15)) == inbox(14, 15)
    # the generation that arrived last counts, whether larger or smaller
    assert step(4, m(16), m(1, generation=2, msg_id=101)) == inbox(1, g=2)
    assert step(5, m(17), m(2, generation=2, msg_id=102), m(1, generation=2, msg_id=101)) == inbox(2, g=2)
    got.clear()
    assert step(6, m(3, generation=2, msg_id=103), m(2, msg_id=104), m(1, msg_id=105)) == inbox(1, 2)
    assert step(7, m(30, "Old", msg_id=106), m(3, msg_id=107)) == inbox(3)  # the other folder kept what it had


def test_stream_of_landed_files(spark, tmp_path, mine):
    """Two files taken one by one: interleaved ids, a gap filled by the second, a folder numbered anew."""
    def m(uid, *rest, **options):
        return landed_mail(uid, *rest, **{"sender": "ann@north-ford.com", "msg_id": uid, **options})

    one = [m(1), m(3), m(5, served=False), m(7), m(8, sender=""), m(31, "Old", generation=1), m(32, "Old", generation=1)]
    two = [m(2), m(5), m(33, "Old", generation=1), m(41, "Old", generation=0)]
    land_files(spark, tmp_path / "landed", one, two)
    store, got = stream(spark, tmp_path, mine)
    assert got == [("INBOX", 1, u) for u in (1, 2, 3, 5, 7)] + [("Old", 0, 41)]
    live = {r["msg_id"]: r["baseline_n"] for r in store.rows("message_scores").collect()}
    assert live == {1: 0, 3: 1, 2: 2, 5: 3, 7: 4, 41: 5}  # 31 and 32 are gone from the state, too
    again = {r["msg_id"]: r["baseline_n"] for r in replay_store(store, names=("cold_links",)).scores.collect()}
    new = rebuild_store(store, str(tmp_path / "rebuilt"), 2)
    fresh = {r["msg_id"]: r["baseline_n"] for r in new.rows("message_scores").collect()}
    assert fresh == again == {1: 0, 2: 1, 3: 2, 5: 3, 7: 4, 41: 5}


def test_no_content_is_stored(spark, tmp_path, mine):
    """Rows that wait behind a gap, and everything else below the store, hold no text and no file names."""
    secret = [("text", "plain", "", None, 9, "PRIVATE BODY http://seen.example.com"), ("application", "pdf", "attachment", "secret-plan.pdf", 5, None)]
    rows = [landed_mail(u, served=u != 2) for u in (1, 2, 3)]
    rows = [(*r[:17], secret, *r[18:]) for r in rows]
    store = Store(spark, str(tmp_path / "s"))
    for batch in (0, 1):
        score_landed_batch(spark.createDataFrame(rows, COLUMNS + ", deleted boolean"), mine, store, batch)
        assert [r["uid"] for r in store.held(batch + 1).filter("served").collect()] == [3]
    found = [f.read_bytes() for f in tmp_path.rglob("*.parquet")]
    assert len(found) > 10
    for table in tmp_path.rglob("*.parquet"):
        shown = repr(pq.read_table(table).to_pylist())
        assert "PRIVATE" not in shown and "secret" not in shown
    assert "example.com" in repr(store.held(2).collect())  # the facts themselves wait


def test_merged_state_gives_the_same_scores(spark, tmp_path):
    rows = random_mailbox(23, n=60, undated=False)
    plain_ = stored(run(spark, tmp_path / "plain", rows, [15, 30, 45]))
    store = Store(spark, str(tmp_path / "merged"))
    for b, lo in enumerate((0, 15, 30, 45)):
        store.merge_if_due(b, 2)
        store.merge_if_due(b, 2)  # as after a failure
        score_batch(frame(spark, rows[lo : lo + 15]), store, b)
    assert stored(store) == plain_ and store._last(f"{store.folder}/merges", None) == (2, 0)
