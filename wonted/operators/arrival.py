"""Credits and silences when messages are judged in order of arrival instead of time.

The time rules stay on sent_at, but a message sees only what arrived before it.  Late rows therefore
make "earlier in time" and "known" two different things, which the replay needs not tell apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wonted.config import DEFAULT_REGISTRY, DEFAULT_SKEW, Registry, SkewPolicy
from wonted.functions.position import position
from wonted.operators.gaps import no_medians, prefix_medians
from wonted.operators.relations import first_credit
from wonted.operators.running import running
from wonted.operators.skew import NONE_HOT, HotKeys
from wonted.session import checkpointed


def initiated(
    incoming: DataFrame,
    outgoing: DataFrame,
    known: DataFrame | None,
    hot: HotKeys = NONE_HOT,
    policy: SkewPolicy = DEFAULT_SKEW,
) -> DataFrame:
    """First outgoing message to someone of whom nothing earlier had arrived in the thread."""
    got = incoming.selectExpr("thread_id", "sender", "msg_id", "sent_at", "false AS out", "sent_at AS seen")
    sent = outgoing.selectExpr(
        "thread_id", "explode(array_distinct(recipients)) AS sender", "msg_id", "sent_at", "true AS out",
        "cast(NULL AS bigint) AS seen",
    )
    return (
        running(
            got.unionByName(sent), ["thread_id", "sender"], ["msg_id"], {"min_in": ("min", "seen")},
            hot=hot.get("thread_id"), policy=policy, carry=known,
        )
        .filter("out AND (min_in IS NULL OR sent_at <= min_in)")
        .groupBy("thread_id", "sender")
        .agg(F.min("msg_id").alias("msg_id"))
        .selectExpr("thread_id", "sender", "'initiated' AS kind", f"{position('msg_id', 'msg_id')} AS pos")
    )


def replied(
    incoming: DataFrame,
    outgoing: DataFrame,
    known: DataFrame | None,
    hot: HotKeys = NONE_HOT,
    policy: SkewPolicy = DEFAULT_SKEW,
) -> DataFrame:
    """First outgoing message that arrived after, and is later than, some message of the sender.

    Only a sender's record-early messages matter: (arrival a, time m) with m below all before.  For
    each the first outgoing o with o.msg_id > a and o.sent_at > m is wanted.  Looking along time alone
    (``later``) gives the first such o of the whole thread, and that is the answer when it arrived after
    a, as it nearly always did; the rest is found in ``later_from``.
    """
    columns = "thread_id", "sender", "a", "m"
    lows = running(
        incoming.select("thread_id", "sender", "msg_id", "sent_at"), ["thread_id", "sender"], ["msg_id"],
        {"min_in": ("min", "sent_at")}, hot=hot.get("thread_id"), policy=policy, carry=known,
    ).filter("min_in IS NULL OR sent_at < min_in")
    records = lows.selectExpr("thread_id", "sender", "msg_id AS a", "sent_at AS m")
    if known is not None:
        active = known.join(outgoing.select("thread_id").distinct(), "thread_id", "left_semi")
        records = records.unionByName(active.selectExpr("thread_id", "sender", "-1L AS a", "min_in AS m"))
    outs = outgoing.select("thread_id", "msg_id", "sent_at")
    looked = checkpointed(later(records, outs, ["thread_id"], hot, policy))
    found = looked.filter("found > a").select(*columns, "found")
    open_ = looked.filter("found <= a").select(*columns)
    if not open_.isEmpty():
        found = found.unionByName(later_from(open_, outs, hot, policy).select(*columns, "found"))
    return (
        found.groupBy("thread_id", "sender")
        .agg(F.min("found").alias("msg_id"))
        .selectExpr("thread_id", "sender", "'replied' AS kind", f"{position('msg_id', 'msg_id')} AS pos")
    )


def later(
    records: DataFrame, outs: DataFrame, keys: list[str], hot: HotKeys, policy: SkewPolicy
) -> DataFrame:
    """Add ``found``: the smallest msg_id of the outgoing rows with the same keys and sent_at > m."""
    asked = records.selectExpr(*records.columns, "m AS t", "1 AS side", "a AS id", "cast(NULL AS bigint) AS out_id")
    fill = [f"cast(NULL AS {t}) AS {c}" for c, t in records.dtypes if c not in keys]
    given = outs.selectExpr(*keys, *fill, "sent_at AS t", "0 AS side", "msg_id AS id", "msg_id AS out_id")
    seen = running(
        asked.unionByName(given), keys, ["t", "side", "id"], {"found": ("min", "out_id")},
        hot=hot.get(keys[0]), policy=policy, descending=True,
    )
    return seen.filter("side = 1 AND found IS NOT NULL").select(*records.columns, "found")


def later_from(
    records: DataFrame, outs: DataFrame, hot: HotKeys = NONE_HOT, policy: SkewPolicy = DEFAULT_SKEW
) -> DataFrame:
    """Add ``found``: the smallest msg_id > a with sent_at > m in the thread.

    Outgoing rows are numbered by arrival and belong to one aligned block of every size 1, 2, 4, ...;
    the rows behind a given one are a union of at most one block per size.  So both sides are copied
    once per size at most and ``later`` is asked inside each block: n log n rows, never all pairs.
    """
    asked = records.selectExpr("*", "a AS msg_id", "1 AS side")
    fill = [f"cast(NULL AS {t}) AS {c}" for c, t in records.dtypes if c != "thread_id"]
    given = outs.selectExpr("thread_id", *fill, "msg_id", "0 AS side", "sent_at")
    numbered = running(
        asked.selectExpr("*", "cast(NULL AS bigint) AS sent_at").unionByName(given),
        ["thread_id"], ["msg_id"], {"r": ("count", "side = 0")}, hot=hot.get("thread_id"), policy=policy,
    )
    level = "explode(sequence(0, 40)) AS level"
    blocks = (
        numbered.filter("side = 0")
        .selectExpr("thread_id", "msg_id", "sent_at", "r", level)
        .filter("shiftright(r, level) % 2 = 1")
        .selectExpr("thread_id", "level", "shiftright(r, level) AS block", "msg_id", "sent_at")
    )
    wanted = (
        numbered.filter("side = 1 AND r > 0")
        .selectExpr(*records.columns, "r - 1 AS last", level)
        .filter("shiftright(last, level) % 2 = 0")
        .selectExpr(*records.columns, "level", "shiftright(last, level) + 1 AS block")
    )
    each = later(wanted, blocks, ["thread_id", "level", "block"], hot, policy)
    return each.groupBy(*records.columns).agg(F.min("found").alias("found"))


def arrival_credits(
    incoming: DataFrame,
    outgoing: DataFrame,
    *,
    known: DataFrame | None = None,
    credited: DataFrame | None = None,
    hot: HotKeys = NONE_HOT,
    policy: SkewPolicy = DEFAULT_SKEW,
) -> DataFrame:
    """New credits of messages judged in order of arrival.

    ``known`` (thread_id, sender, min_in) and ``credited`` (thread_id, sender) come from earlier batches.
    """
    events = first_credit(
        replied(incoming, outgoing, known, hot, policy).unionByName(
            initiated(incoming, outgoing, known, hot, policy)
        )
    )
    if credited is None:
        return events
    return events.join(credited.select("thread_id", "sender"), ["thread_id", "sender"], "left_anti")


def arrival_gap_events(
    state: DataFrame, past: Callable[[DataFrame], DataFrame], hot: HotKeys = NONE_HOT, policy: SkewPolicy = DEFAULT_SKEW
) -> DataFrame:
    """(sender, at, g, n): how each message of a batch changes its sender's gaps between neighbouring times.

    ``state`` has sender, msg_id, sent_at, p_last.  A message in order adds the gap since the latest time.  A late one
    falls into a gap, which it splits in two; only for senders with late messages is ``past(senders)`` read: all
    times (sender, msg_id, sent_at) that arrived before the batch.
    """
    times = state.select("sender", "msg_id", "sent_at", "p_last")
    added = times.filter("sent_at >= p_last").selectExpr("sender", "msg_id AS at", "sent_at - p_last AS g", "1L AS n")
    late = checkpointed(times.filter("sent_at < p_last").selectExpr("sender", "msg_id AS a", "sent_at AS m"))
    if late.isEmpty():
        return added
    senders = late.select("sender").distinct()
    arrived = past(senders).unionByName(times.join(senders, "sender", "left_semi").select("sender", "msg_id", "sent_at"))
    split = neighbours(late, arrived, hot, policy)
    changes = split.selectExpr(
        "sender", "a AS at", "inline(array(struct(above - m AS g, 1L AS n), struct(m - below AS g, 1L AS n), struct(above - below AS g, -1L AS n)))"
    )
    return added.unionByName(changes.filter("g IS NOT NULL"))


def neighbours(records: DataFrame, arrived: DataFrame, hot: HotKeys = NONE_HOT, policy: SkewPolicy = DEFAULT_SKEW) -> DataFrame:
    """Add to (sender, a, m) the latest time up to m and the earliest after it among rows of the sender that arrived before a.

    The rows before a given one are a union of at most one aligned block of each size 1, 2, 4, ...: both sides are
    copied once per size at most, and each block is looked through in order of time.
    """
    rows = records.selectExpr("sender", "a AS msg_id", "m AS t", "1 AS side").unionByName(
        arrived.selectExpr("sender", "msg_id", "sent_at AS t", "0 AS side")
    )
    numbered = running(rows, ["sender"], ["msg_id", "side"], {"r": ("count", "side = 0")}, hot=hot.get("sender"), policy=policy)
    # a record is in the table of arrived rows too, where it does not count for itself
    numbered = numbered.selectExpr("sender", "msg_id", "t", "side", "if(side = 1, r - 1, r) AS r", "explode(sequence(0, 40)) AS level")
    placed = numbered.filter(
        "if(side = 0, shiftright(r, level) % 2 = 0, shiftright(r, level) % 2 = 1)"
    ).selectExpr("sender", "msg_id", "t", "side", "level", "shiftright(r, level) - side AS block", "if(side = 0, t, NULL) AS given")
    keys = ["sender", "level", "block"]
    low = running(placed, keys, ["t", "side", "msg_id"], {"below": ("max", "given")}, hot=hot.get("sender"), policy=policy)
    both = running(low, keys, ["t", "side", "msg_id"], {"above": ("min", "given")}, hot=hot.get("sender"), policy=policy, descending=True)
    return both.filter("side = 1").groupBy("sender", F.col("msg_id").alias("a"), F.col("t").alias("m")).agg(
        F.max("below").alias("below"), F.min("above").alias("above")
    )


def arrival_median_gaps(
    state: DataFrame, events: DataFrame, known: Callable[[DataFrame], DataFrame], *, registry: Registry = DEFAULT_REGISTRY
) -> DataFrame:
    """(msg_id, gap, median_gap) of messages after a long silence, from the gaps that had arrived.

    ``events`` are those of the batch, ``known(senders)`` the counted gaps (sender, g, n) of earlier batches, read for
    the senders that were silent, if any.
    """
    silent = state.filter(
        f"sent_at - p_last >= {registry.dormant_gap} AND p_n >= {registry.min_baseline}"
    ).selectExpr("sender", "msg_id AS at", "msg_id", "sent_at - p_last AS gap")
    silent = checkpointed(silent)
    if silent.isEmpty():
        return no_medians(state)
    senders = silent.select("sender").distinct()
    earlier = known(senders).selectExpr("sender", "-1L AS at", "g", "n")
    return prefix_medians(earlier.unionByName(events.join(senders, "sender", "left_semi")), silent)
