"""Ingest runs: nothing twice, gaps tried again, changed generations read anew, own mail told apart."""

from types import SimpleNamespace

import pytest

from wonted.config import DEFAULT_REGISTRY
from wonted.functions.domains import SuffixRules
from wonted.plans.ingest import ingest
from wonted.plans.rebuild import replay
from wonted.sources import tables
from wonted.sources.facts import prepare
from wonted.sources.landed import PART

COLUMNS = (
    "account_id bigint, folder string, folder_role string, generation bigint, uid bigint, msg_id bigint, "
    "size_bytes bigint, from_name string, from_addr string, reply_to_addr string, to_addrs array<string>, "
    "cc_addrs array<string>, date_hdr string, message_id_hdr string, in_reply_to_hdr string, "
    f"references_hdr string, auth_results_hdr string, parts array<{PART}>, served boolean"
)
FOLDERS = "account_id bigint, folder string, role string, generation bigint, last_seen_uid bigint"


def row(uid, sender="mira@north-ford.com", folder="INBOX", role="inbox", generation=1, auth=None, served=True):
    return (1, folder, role, generation, uid, uid, 10, None, sender, None, ["me@x.org"], [],
            "Wed, 3 Sep 2025 10:15:00 +0000", f"<{uid}@t>", None, None, auth, [], served)


@pytest.fixture(scope="module")
def mine(spark):
    return spark.createDataFrame([(1, "ottokvance@gmail.com")], "account_id bigint, email_norm string")


def land(spark, *rows):
    return spark.createDataFrame(list(rows), COLUMNS)


def test_runs(spark, mine):
    empty = spark.createDataFrame([], FOLDERS)
    first = ingest(land(spark, row(1), row(2, served=False), row(3)), mine, empty)
    assert first.stats.new_messages == 1 and first.stats.initial_backfill and first.stats.needs_rebuild
    second = ingest(land(spark, row(1), row(2), row(3)), mine, first.folders, first.facts)
    assert second.stats.new_messages == 2 and not second.stats.needs_rebuild
    third = ingest(land(spark, row(1), row(2), row(3)), mine, second.folders, second.facts)
    assert third.stats.new_messages == 0 and third.facts.count() == 3
    renumbered = [row(10 + i, generation=2) for i in range(3)]
    fourth = ingest(land(spark, *renumbered), mine, third.folders, third.facts)
    assert fourth.stats.invalidated == 1 and fourth.stats.needs_rebuild
    assert {r["uid"] for r in fourth.facts.collect()} == {10, 11, 12}
    assert fourth.folders.first()["generation"] == 2


def test_direction_and_missing_sender(spark, mine):
    rows = [
        row(1, "Otto.K.Vance@gmail.com"),
        row(2, "ottokvance@gmail.com", auth="mx; dmarc=fail"),
        row(3, ""),
        row(4, "other@x.org", "Sent", "sent"),
        row(5, "d@x.org", "Odd", "strange"),
    ]
    run = ingest(land(spark, *rows), mine, spark.createDataFrame([], FOLDERS))
    got = {r["uid"]: r["direction"] for r in run.facts.collect()}
    assert got == {1: "out", 2: "in", 4: "out"}  # no sender and no known role: not stored
    marks = {r["folder"]: r["last_seen_uid"] for r in run.folders.collect()}
    assert marks == {"INBOX": 3, "Sent": 4}


def test_runs_over_a_table_that_only_grows(spark, mine, tmp_path):
    """Old generations and folders of unknown role stay listed; every run is stored and one is done twice."""
    place, listed = str(tmp_path), []
    empty = spark.createDataFrame([], FOLDERS)

    def step(number, *rows):
        listed.extend(rows)
        state = tables.read_folders(spark, place)
        done = ingest(land(spark, *listed), mine, empty if state is None else state, tables.read_facts(spark, place))
        tables.write_run(done, place, number)
        stored = tables.read_facts(spark, place).collect()
        return done.stats, sorted((r["folder"], r["generation"], r["uid"]) for r in stored)

    stats, stored = step(0, row(1), row(2), row(3, folder="Odd", role="strange"), row(4, folder="Sent", role="sent"))
    assert stats.new_messages == 3 and stored == [("INBOX", 1, 1), ("INBOX", 1, 2), ("Sent", 1, 4)]
    stats, stored = step(1)
    assert (stats.new_messages, stats.invalidated) == (0, 0) and len(stored) == 3
    stats, stored = step(2, row(5), row(6, folder="Sent", role="sent"))  # earlier rows of the folders stay
    assert stats.new_messages == 2 and len(stored) == 5
    again = [("INBOX", 3, 1), ("INBOX", 3, 2), ("Sent", 1, 4), ("Sent", 1, 6)]
    late = lambda uid, msg_id, generation: (*row(uid, generation=generation)[:5], msg_id, *row(uid)[6:])
    stats, stored = step(3, row(7, generation=2), late(1, 11, 3), late(2, 12, 3))
    assert (stats.new_messages, stats.invalidated, stats.stale) == (2, 1, 4) and stored == again
    for number in (4, 4):
        stats, stored = step(number)
        assert (stats.new_messages, stats.invalidated) == (0, 0) and stored == again
    # numbered anew once more, with a smaller generation: what arrived last counts
    stats, stored = step(5, late(1, 21, 2))
    assert (stats.new_messages, stats.invalidated, stats.stale) == (2, 1, 5) and stored[:2] == [("INBOX", 2, 1), ("INBOX", 2, 7)] and len(stored) == 4


def test_numbers_in_order_of_arrival(spark, mine):
    """Sent folders first, then by folder and uid; the source's own listing decides what is current."""
    rows = [row(u, folder=f, role=r, generation=g) for f, r, g in (("INBOX", "inbox", 4), ("Sent", "sent", 1), ("INBOX", "inbox", 9)) for u in (3, 1, 2)]
    df = land(spark, *rows).drop("msg_id").repartition(4)
    listing = spark.createDataFrame([(1, "INBOX", "inbox", 4), (1, "Sent", "sent", 1), (1, "Odd", "strange", 1)], "account_id bigint, folder string, role string, generation bigint")
    run = ingest(df, mine, spark.createDataFrame([], FOLDERS), listing=listing, first_number=100)
    got = sorted((r["msg_id"], r["folder"], r["generation"], r["uid"]) for r in run.facts.collect())
    assert got == [(100 + i, "Sent", 1, i + 1) for i in range(3)] + [(103 + i, "INBOX", 4, i + 1) for i in range(3)]
    assert run.stats.stale == 3 and {r["folder"] for r in run.folders.collect()} == {"INBOX", "Sent"}


def test_sink_deletes_and_repeats(spark, tmp_path):
    place = str(tmp_path)
    schema = "account_id bigint, folder string, generation bigint, uid bigint, msg_id bigint"
    some = lambda *rows: spark.createDataFrame([(*r, r[3]) for r in rows], schema)
    held = lambda: sorted((r["account_id"], r["folder"], r["uid"]) for r in tables.read_facts(spark, place).collect())
    assert tables.read_facts(spark, place) is None
    tables.write_facts(some((1, "A", 1, 1), (1, "A", 1, 1), (1, "B", 1, 2), (2, "A", 1, 3)), place, 0)
    tables.write_facts(some((1, "A", 1, 1), (1, "A", 1, 4)), place, 1)
    tables.write_facts(some((1, "A", 1, 1), (1, "A", 1, 4)), place, 1)
    assert held() == [(1, "A", 1), (1, "A", 4), (1, "B", 2), (2, "A", 3)]
    gone = spark.createDataFrame([(1, "A"), (2, None)], "account_id bigint, folder string")
    for _ in range(2):
        tables.forget(gone, place, 2)
        tables.write_facts(some((1, "A", 1, 4)), place, 2)
    assert held() == [(1, "A", 4), (1, "B", 2)]


def test_scores_are_replaced_by_message(spark, tmp_path):
    place = str(tmp_path)
    scores = "msg_id bigint, engine_version string, anomaly_score double"
    features = "msg_id bigint, feature string"

    def put(run, rows):
        tables.write_scores(
            spark.createDataFrame([(m, v, s) for m, v, s, _ in rows], scores),
            spark.createDataFrame([(m, f) for m, _, _, fs in rows for f in fs], features), place, run,
        )

    put(0, [(1, "old", 5.0, ["a", "b"]), (2, "1.0.0", 3.0, ["a"])])
    now = SimpleNamespace(
        scores=spark.createDataFrame([(1, "1.0.0", 7.0), (2, "1.0.0", 9.0)], scores),
        features=spark.createDataFrame([(1, "c"), (2, "d")], features), registry=DEFAULT_REGISTRY,
    )
    for _ in range(2):  # the second time nothing is stale
        tables.rescore_stale(now, place, 1 + _)
        got, why = tables.read_scores(spark, place)
        assert {(r["msg_id"], r["anomaly_score"]) for r in got.collect()} == {(1, 7.0), (2, 3.0)}
        assert {(r["msg_id"], r["feature"]) for r in why.collect()} == {(1, "c"), (2, "a")}


def test_loaded_suffix_rules_reach_every_step(spark):
    """A colleague of a replied-to sender is known by organization, also below a suffix only the file has."""
    def mail(i, sender, direction="in"):
        return {"msg_id": i, "sent_at": 1000 * i, "from_email_norm": sender, "direction": direction, "thread_id": 1 if i < 3 else i,
                "recipients": ["ann@mx.big.ltd.uk"] if direction == "out" else []}

    rows = [mail(1, "ann@mx.big.ltd.uk"), mail(2, "me@x.org", "out"), mail(3, "bob@big.ltd.uk"), mail(4, "eve@other.ltd.uk")]
    df = spark.createDataFrame(rows, "msg_id bigint, sent_at bigint, from_email_norm string, direction string, thread_id bigint, recipients array<string>")
    loaded = DEFAULT_REGISTRY.changed(suffixes=SuffixRules.from_lines(["uk", "ltd.uk", "org"], "file"))
    assert loaded.version != DEFAULT_REGISTRY.version
    for registry, eve in ((loaded, 0), (DEFAULT_REGISTRY, 1)):
        d = replay(prepare(df, registry=registry), registry=registry, names=("cold_links",))
        tiers = {r["msg_id"]: r["trust_tier_at_scoring"] for r in d.scores.collect()}
        assert tiers[3] == 1 and tiers[4] == eve
