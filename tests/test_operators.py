"""Threads, lookalikes, running state, joins, ingest state and reports on small fixtures."""

import math
import random
import statistics
from collections import Counter
from fractions import Fraction

import pytest
from brute import osa
from mailboxes import frame, random_mailbox
from pyspark.sql import functions as F
from test_replay import TINY

from wonted.config import SkewPolicy
from wonted.functions.position import position
from wonted.functions.stats import mean_of, squared, std_of, units
from wonted.functions.text import normalize_display_name, skeleton
from wonted.operators import gaps, lookalike
from wonted.operators.arrival import arrival_gap_events
from wonted.operators.folding import with_names
from wonted.operators.gaps import prefix_medians
from wonted.operators.ordinals import numbered
from wonted.operators.running import running
from wonted.operators.skew import find_hot_keys, salted_left_join
from wonted.operators.threads import resolve_threads
from wonted.plans import reports
from wonted.plans.rebuild import replay
from wonted.session import checkpointed
from wonted.sources import facts, landed, tables
from wonted.sources.facts import prepare
from wonted.streaming.incremental import score_batch, score_stream
from wonted.streaming.store import Store

THREAD_COLUMNS = "msg_id bigint, message_id string, in_reply_to string, references array<string>"


def random_headers(r, n):
    ids = [f"<{i}>" for i in range(n // 2)]
    pick = lambda p: r.choice(ids) if r.random() < p else None
    return [(i + 1, pick(0.9), pick(0.5), r.sample(ids, r.choice([0, 0, 1, 3]))) for i in range(n)]


def threads_by_definition(rows):
    seen, opened, out = [], {}, {}
    for i, mid, reply, refs in rows:
        for ref in ([reply] if reply else []) + refs[::-1]:
            hit = next((o for o in seen if o[0] == ref), None)
            if hit:
                out[i] = (hit[1], hit[2] + 1)
                break
        else:
            key = refs[0] if refs else mid
            thread = i if key is None else opened.setdefault(key, i)
            out[i] = (thread, 1 if refs else 0)
        seen.append((mid, *out[i]))
    return out


@pytest.mark.parametrize("policy", [SkewPolicy(), TINY], ids=["plain", "split"])
def test_threads(spark, policy):
    rows = random_headers(random.Random(3), 120)
    chain = [(1000 + i, f"<c{i}>", f"<c{i - 1}>" if i else None, []) for i in range(40)]
    df = spark.createDataFrame(rows + chain, THREAD_COLUMNS)
    got = {r["msg_id"]: (r["thread_id"], r["thread_depth"]) for r in resolve_threads(df, policy=policy).collect()}
    assert got == threads_by_definition(rows + chain)
    assert got[1039] == (1000, 39)


def test_threads_continue_from_stored_ones(spark):
    rows = random_headers(random.Random(4), 100)
    df = spark.createDataFrame(rows, THREAD_COLUMNS)
    early = checkpointed(resolve_threads(df.filter("msg_id <= 60")).join(df, "msg_id"))
    roots = early.filter("root_key IS NOT NULL").select("root_key", "thread_id").distinct()
    late = resolve_threads(df.filter("msg_id > 60"), known=early, known_roots=roots)
    got = {r["msg_id"]: (r["thread_id"], r["thread_depth"]) for r in early.select("msg_id", "thread_id", "thread_depth").union(
        late.select("msg_id", "thread_id", "thread_depth")).collect()}
    assert got == threads_by_definition(rows)


def test_lookalikes_against_all_pairs(spark):
    r = random.Random(8)
    names = {"".join(r.choice("abc1l") for _ in range(r.randint(2, 6))) + ".io" for _ in range(150)}
    rows = [(d, i + 1 if r.random() < 0.5 else None) for i, d in enumerate(sorted(names))]
    df = spark.createDataFrame(rows, "rd string, at bigint").selectExpr(
        "rd", f"if(at IS NULL, NULL, {position('at', 'at')}) AS trust_pos"
    )
    got = {
        x["rd"]: tuple(x[f"look{k}"]["target"] if x[f"look{k}"] else None for k in (0, 1, 2))
        for x in lookalike.lookalikes(df).collect()
    }
    fold = str.maketrans("0135", "oles")
    for d, _ in rows:
        want = []
        for k in (0, 1, 2):
            near = [
                (at, t) for t, at in rows
                if at and t != d and min(len(t), len(d)) >= 6 and osa(d.translate(fold), t.translate(fold)) <= k
            ]
            want.append(min(near)[1] if near else None)
        assert got.get(d, (None,) * 3) == tuple(want), d


@pytest.mark.parametrize("descending", [False, True])
def test_running_state_of_split_keys(spark, descending):
    r = random.Random(1)
    rows = [(r.choice(["hot", "hot", "warm", f"k{i % 9}"]), r.choice([0, 5, 5, 5, 9, i]), i, r.randint(-5, 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, t bigint, id bigint, v bigint")
    carry = spark.sql("SELECT stack(3, 'hot', 100L, 7L, 'k1', 50L, 1L, 'absent', 1L, 1L) AS (k, s, n)").selectExpr("*", "-99L AS lo")
    aggs = {"s": ("sum", "v"), "lo": ("min", "v"), "n": ("count", "v > 0")}
    hot = find_hot_keys(df, ["k"], "t", "id", TINY).get("k")
    assert hot is not None
    for c in (None, carry):
        out = running(df, ["k"], ["t", "id"], aggs, hot=hot, policy=TINY, carry=c, descending=descending)
        got = {x["id"]: (x["s"], x["lo"], x["n"]) for x in out.collect()}
        state = {"hot": (100, 7), "k1": (50, 1)} if c else {}
        for k, t, i, _ in rows:
            before = [x[3] for x in rows if x[0] == k and ((x[1], x[2]) > (t, i) if descending else (x[1], x[2]) < (t, i))]
            s, n = state.get(k, (None, 0))
            want = (
                (s or 0) + sum(before) if before or s is not None else None,
                min(before + ([-99] if k in state else []), default=None),
                n + sum(v > 0 for v in before),
            )
            assert got[i] == want, (k, t, i)


def test_salted_join_keeps_every_row(spark):
    left = spark.range(500).selectExpr("id", "if(id % 3 = 0, 'hot', if(id % 7 = 0, NULL, concat('k', id % 50))) AS k")
    right = spark.sql("SELECT explode(array('hot', 'k1', 'k2')) AS k").selectExpr("k", "length(k) AS n")
    hot = find_hot_keys(left, ["k"], "id", "id", SkewPolicy(hot_rows=20, chunk_rows=10)).get("k")
    assert {r["key"] for r in hot.collect()} == {"hot"}
    plain = left.join(right, "k", "left").select("id", "k", "n").collect()
    salted = salted_left_join(left, right, "k", "id", hot, TINY).select("id", "k", "n").collect()
    assert sorted(map(str, plain)) == sorted(map(str, salted))


def test_ingest_state(spark):
    rows = [(1, "A", u, 2, u != 3) for u in (1, 2, 3, 4)] + [(1, "B", u, 2, True) for u in (5, 6)]
    batch = spark.createDataFrame(rows, "account_id bigint, folder string, uid bigint, generation bigint, served boolean")
    folders = spark.createDataFrame(
        [(1, "A", "inbox", 2, 1), (1, "B", "sent", 1, 9)],
        "account_id bigint, folder string, role string, generation bigint, last_seen_uid bigint",
    )
    for policy in (SkewPolicy(), SkewPolicy(broadcast_rows=0), SkewPolicy(hot_rows=1, chunk_rows=1, broadcast_rows=0)):
        assert {r["uid"] for r in landed.unseen_rows(batch, folders, policy).collect()} == {2, 3, 4}
        kept = landed.contiguous_prefix(landed.unseen_rows(batch, folders), policy)
        assert {r["uid"] for r in kept.collect()} == {2}
    marks = {r["folder"]: r["last_seen_uid"] for r in landed.advanced_marks(folders, kept).collect()}
    assert marks == {"A": 2, "B": 9}
    server = batch.select("account_id", "folder", "generation").distinct()
    left, state = landed.drop_invalidated(batch, folders, server)
    assert {r["folder"] for r in left.collect()} == {"A"}
    assert {(r["folder"], r["generation"], r["last_seen_uid"]) for r in state.collect()} == {("A", 2, 1), ("B", None, 0)}
    listed = spark.createDataFrame([(1, "A", "inbox"), (1, "C", "sent")], "account_id bigint, folder string, role string")
    assert {r["folder"] for r in landed.known_folders(folders, listed).collect()} == {"A", "B", "C"}
    stats = landed.run_stats(batch, kept, folders, landed.invalidated_folders(folders, server))
    assert (stats.new_messages, stats.invalidated, stats.initial_backfill, stats.needs_rebuild) == (1, 1, False, True)
    facts_left, reset = landed.switch_source(batch, folders, 1)
    assert facts_left.isEmpty() and {r["last_seen_uid"] for r in reset.collect()} == {0}


def test_accounts_and_identities(spark):
    accounts = spark.createDataFrame(
        [(1, "J.Doe@gmail.com", ["jdoe@gmail.com", "JD@x.org"], "oauth2"), (2, "a@b.org", None, "carrier pigeon")],
        "id bigint, email string, aliases array<string>, auth_method string",
    )
    assert [r["id"] for r in landed.valid_accounts(accounts).collect()] == [1]
    got = {(r["account_id"], r["email_norm"]) for r in landed.identities(accounts).collect()}
    assert got == {(1, "jdoe@gmail.com"), (1, "jd@x.org"), (2, "a@b.org")}


def test_tables_and_reports(spark, tmp_path):
    rows = random_mailbox(13, n=60)
    f = prepare(frame(spark, rows)).withColumn("generation", facts.F.lit(1)).withColumn("uid", facts.F.col("msg_id"))
    tables.write_facts(f.unionByName(f), str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/messages").count() == len(rows)
    tables.write_dimensions(f, str(tmp_path))
    d = replay(f, cut=checkpointed)
    tables.write_derived(d, str(tmp_path))
    read = lambda n: tables.read_derived(spark, str(tmp_path), n)
    profiles, scores = read("sender_profiles"), read("message_scores").drop("scored_at")
    n_in = sum(m["direction"] == "in" for m in rows)
    assert scores.count() == n_in == read("domain_profiles").agg({"n_messages": "sum"}).first()[0]
    tiers = profiles.select("sender", "trust_tier")
    top = reports.listing(d.incoming, scores, tiers, limit=5)
    best = sorted((r["anomaly_score"] for r in scores.collect()), reverse=True)[:5]
    assert [r["anomaly_score"] for r in top.collect()] == best
    detailed = reports.listing_details(top, read("message_score_features")).collect()
    for r in detailed:
        points = [x["contribution"] for x in r["features"]]
        assert points == sorted(points, reverse=True) and min(100, sum(points)) == pytest.approx(r["anomaly_score"])
    assert reports.listing(d.incoming, scores, tiers, tier=3).filter("tier <> 3").isEmpty()
    assert reports.listing(d.incoming, scores, tiers, limit=5000).count() == min(n_in, 1000)
    senders = spark.read.parquet(f"{tmp_path}/senders")
    assert tuple(reports.status(f, senders).first()) == (len(rows), n_in, senders.count())
    assert reports.sender_detail(senders, profiles, "nobody@x.org").isEmpty()
    assert reports.listing_json(top).count() == 5
    nested = facts.assemble_facts(
        f.select("msg_id"), spark.read.parquet(f"{tmp_path}/message_attachments"),
        spark.read.parquet(f"{tmp_path}/message_link_domains"),
    ).collect()
    links = {m["msg_id"]: m["link_domains"] for m in rows}
    assert all((r["link_domains"] or {}) == links[r["msg_id"]] for r in nested)


def test_stream_threads_and_compaction(spark, tmp_path):
    """Files land one by one; threads come from headers; a compacted store continues equally."""
    rows = random_mailbox(17, n=40, undated=False)
    headers = random_headers(random.Random(2), 40)
    for m, (_, mid, reply, refs) in zip(rows, headers, strict=True):
        m |= {"message_id": mid, "in_reply_to": reply, "references": refs}
    from mailboxes import COLUMNS

    columns = COLUMNS.replace("thread_id bigint, thread_depth int, ", "") + (
        ", message_id string, in_reply_to string, references array<string>"
    )
    df = spark.createDataFrame([{k: v for k, v in m.items() if not k.startswith("thread")} for m in rows], columns)
    df.filter("msg_id <= 20").write.mode("append").parquet(f"{tmp_path}/landed")
    source = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/landed")
    score_stream(source, f"{tmp_path}/store", f"{tmp_path}/offsets").awaitTermination()
    store = Store(spark, f"{tmp_path}/store")
    assert store.rows("message_scores").count() == sum(m["direction"] == "in" for m in rows[:20])
    compacted = store.compact(f"{tmp_path}/compacted", 0)
    df.filter("msg_id > 20").write.mode("append").parquet(f"{tmp_path}/landed")
    score_stream(source, f"{tmp_path}/store", f"{tmp_path}/offsets").awaitTermination()
    score_batch(df.filter("msg_id > 20"), compacted, 1)
    scores = [sorted(map(tuple, s.rows("message_scores").drop("batch_id").collect())) for s in (store, compacted)]
    assert scores[0] == scores[1] and len(scores[0]) == sum(m["direction"] == "in" for m in rows)
    threads = {r["msg_id"]: (r["thread_id"], r["thread_depth"]) for r in store.rows("messages").collect()}
    assert threads == threads_by_definition(headers)


def test_moments_are_exact_under_any_split(spark):
    """Values near 1e9 with a spread of 1: nine digits of the spread, and the same bits however the rows are dealt."""
    value = "1e9D + sin(id * 0.7D) + cos(id * 1.3D)"
    rows = spark.range(200_000).selectExpr("id", f"{value} AS x")
    u = units("x", 6)

    def of(df):
        total = df.selectExpr(f"{u} AS u").selectExpr("count(*) AS n", "sum(u) AS t", f"sum({squared('u')}) AS s")
        return total.selectExpr(f"{mean_of('t', 'n', 6)} AS mean", f"{std_of('t', 's', 'n', 6)} AS std").first()

    got = [of(rows.repartition(k, by)) for k, by in ((1, "id"), (7, F.col("id") % 3), (16, F.xxhash64("id")))]
    assert len({tuple(r) for r in got}) == 1
    xs = [math.floor(1e6 * r[0] + 0.5) for r in rows.select("x").collect()]
    mean = Fraction(sum(xs), len(xs))
    std = math.sqrt(sum((x - mean) ** 2 for x in xs) / (len(xs) - 1)) / 1e6
    assert got[0]["std"] == pytest.approx(std, rel=1e-12) and got[0]["mean"] == pytest.approx(float(mean) / 1e6, rel=1e-15)
    one = rows.filter("id = 5")
    assert of(one)["std"] == 0 and of(rows.filter("id < 0"))["mean"] is None


@pytest.mark.parametrize("digit", [6, 2])
def test_medians_of_prefixes(spark, monkeypatch, digit):
    """One sender with many events and readers, others with few; counts may be taken back.  With the smaller digit a round
    costs less than looking through the events, so values are found digit by digit."""
    monkeypatch.setattr(gaps, "DIGIT", digit)
    rng = random.Random(7)
    events = [("a", rng.randrange(90), rng.choice([0, 5, 5, 70, 2**31, rng.randrange(10**7)]), rng.choice([1, 1, 3])) for _ in range(900)]
    events += [("b", i, 100 * i, 1) for i in range(4)] + [("a", 80, 5, -1)] * 2
    readers = [("a", at, i, 1) for i, at in enumerate(rng.randrange(95) for _ in range(25))] + [("b", 1, 100, 1), ("b", 2, 101, 1), ("c", 5, 102, 1), ("b", 9, 103, 1)]
    got = prefix_medians(
        spark.createDataFrame(events, "sender string, at bigint, g bigint, n bigint"),
        spark.createDataFrame(readers, "sender string, at bigint, msg_id bigint, gap bigint"),
    )
    want = {}
    for sender, at, i, _ in readers:
        counts = Counter()
        for s, a, g, n in events:
            if s == sender and a < at:
                counts[g] += n
        seen = sorted(counts.elements())
        if len(seen) >= 2:
            want[i] = statistics.median(seen)
    assert {r["msg_id"]: r["median_gap"] for r in got.collect()} == want and 103 in want and 102 not in want


def test_gap_events_of_late_messages(spark):
    """What arrives late splits a gap: at any moment the counted gaps are those between the sorted times."""
    rng = random.Random(8)
    rows, last = [], {}
    for i in range(130):
        sender, t = rng.choice("ab"), rng.randrange(300)
        rows.append((sender, i, t, last.get(sender)))
        last[sender] = max(t, last.get(sender, t))
    batch = spark.createDataFrame(rows[50:], "sender string, msg_id bigint, sent_at bigint, p_last bigint")
    before = spark.createDataFrame([r[:3] for r in rows[:50]], "sender string, msg_id bigint, sent_at bigint")
    found = arrival_gap_events(batch, lambda who: before.join(who, "sender", "left_semi")).collect()

    def between(sender, upto):
        times = sorted(t for s, i, t, _ in rows[:upto] if s == sender)
        return Counter(b - a for a, b in zip(times, times[1:]))

    for upto in (50, 51, 60, 99, 130):
        for sender in "ab":
            counts = between(sender, 50)
            for r in found:
                if r["sender"] == sender and r["at"] < upto:
                    counts[r["g"]] += r["n"]
            assert {g: n for g, n in counts.items() if n} == dict(between(sender, upto))


def test_numbers_follow_the_order(spark):
    rows = [(a, b) for a in range(40) for b in (3, 1, 2)]
    df = spark.createDataFrame(rows, "a bigint, b bigint").repartition(5)
    got = {(r["a"], r["b"]): r["n"] for r in numbered(df, ["a % 2", "a", "b"], "n", 10).collect()}
    assert got == {k: 10 + i for i, k in enumerate(sorted(rows, key=lambda r: (r[0] % 2, *r)))}


def test_names_are_folded_once_per_distinct_text(spark):
    names = ["Anna  Bell", "'Ünal' Özil", "STRASSE", "Straße", None, "", "  ", "Ünal", "раура1"]
    df = spark.createDataFrame([(i, names[i % len(names)]) for i in range(60)], "msg_id bigint, from_display_name string")
    got = {r["from_display_name"]: (r["name_norm"], r["name_skel"]) for r in with_names(df).collect()}
    by_row = df.select("from_display_name", F.nullif(normalize_display_name("from_display_name"), F.lit("")).alias("n"))
    want = {r["from_display_name"]: (r["n"], r["s"]) for r in by_row.select("*", skeleton("n").alias("s")).collect()}
    assert got == want and got["Straße"][0] == "strasse" and got[""] == (None, None)
    plain_ = with_names(df.filter("from_display_name = 'STRASSE'"))
    assert "Python" not in plain_._jdf.queryExecution().toString()  # nothing but ASCII: no Python at all
