"""Reply credits, trust activation positions and trust tiers.

A position stands for (t, msg_id) with t = sent_at when history is replayed in time order.  Credits and
tiers 2 and 3 never go away, so "was true before this message" is one comparison with the position at
which it became true.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wonted.config import DEFAULT_REGISTRY, DEFAULT_SKEW, Registry, SkewPolicy
from wonted.functions.domains import is_freemail, reg_domain_of_clean
from wonted.functions.position import TYPE, time_of
from wonted.functions.text import address_domain
from wonted.operators.baseline import TIMES, prior_state
from wonted.operators.running import running
from wonted.operators.skew import NONE_HOT, HotKeys, salted_left_join



def thread_senders(incoming: DataFrame) -> DataFrame:
    """(thread, sender) with the earliest time the sender wrote in the thread."""
    return incoming.groupBy("thread_id", "sender").agg(F.min("sent_at").alias("min_in"))


def addressed(outgoing: DataFrame) -> DataFrame:
    """(thread, recipient) with the first outgoing message addressed to the recipient."""
    return (
        outgoing.selectExpr("thread_id", "pos", "explode(array_distinct(recipients)) AS sender")
        .groupBy("thread_id", "sender")
        .agg(F.min("pos").alias("pos"))
    )


def reply_credits(
    incoming: DataFrame,
    outgoing: DataFrame,
    *,
    hot: HotKeys = NONE_HOT,
    policy: SkewPolicy = DEFAULT_SKEW,
) -> DataFrame:
    """One credit per (thread, sender): kind "replied" or "initiated", whichever came first, and pos.

    Replied: the first outgoing message of the thread later than the sender's earliest one.  It is
    found by looking ahead in the ordered thread, not by pairing messages; an outgoing message at the
    same second is not later, so it sorts in front.  Initiated: only the first message addressed to
    someone can be one, because later ones follow either that credit or an earlier incoming message.
    """
    wrote = thread_senders(incoming)
    marks = wrote.selectExpr(
        "thread_id", "min_in AS t", "1 AS side", "0L AS id", "sender", f"cast(NULL AS {TYPE}) AS out_pos"
    )
    sent = outgoing.selectExpr(
        "thread_id", "sent_at AS t", "0 AS side", "msg_id AS id", "cast(NULL AS string) AS sender", "pos AS out_pos"
    )
    replied = (
        running(
            marks.unionByName(sent),
            ["thread_id"],
            ["t", "side", "id"],
            {"next_out": ("min", "out_pos")},
            hot=hot.get("thread_id"),
            policy=policy,
            descending=True,
        )
        .filter("side = 1 AND next_out IS NOT NULL")
        .selectExpr("thread_id", "sender", "'replied' AS kind", "next_out AS pos")
    )
    initiated = (
        addressed(outgoing)
        .join(wrote, ["thread_id", "sender"], "left")
        .filter(f"min_in IS NULL OR {time_of('pos')} <= min_in")
        .selectExpr("thread_id", "sender", "'initiated' AS kind", "pos")
    )
    return first_credit(replied.unionByName(initiated))


def first_credit(events: DataFrame) -> DataFrame:
    """The earlier one of each pair's two kinds of credit (they never share a message)."""
    firsts = [F.expr(f"min(if(kind = '{k}', pos, NULL)) AS {k}") for k in ("replied", "initiated")]
    return events.groupBy("thread_id", "sender").agg(*firsts).selectExpr(
        "thread_id", "sender",
        "if(initiated IS NULL OR replied < initiated, 'replied', 'initiated') AS kind",
        "least(replied, initiated) AS pos",
    )


def sender_domain(registry: Registry = DEFAULT_REGISTRY) -> str:
    return reg_domain_of_clean(address_domain("sender"), registry.suffixes)


def domain_replies(credits: DataFrame, registry: Registry = DEFAULT_REGISTRY) -> DataFrame:
    """Per domain the first "replied" credit and their number."""
    return (
        credits.filter("kind = 'replied'")
        .selectExpr(f"{sender_domain(registry)} AS rd", "pos")
        .groupBy("rd")
        .agg(F.min("pos").alias("reply_pos"), F.count(F.lit(1)).alias("n_replied_threads"))
    )


def one_way_known(first: str, last: str, n: str, registry: Registry) -> str:
    return f"{n} >= {registry.one_way_messages} AND {last} - {first} >= {registry.one_way_span}"


def own_included(registry: Registry) -> str:
    """Whether the one-way rule holds once the row itself is counted."""
    first, last = "least(p_first, nullif(sent_at, 0L))", "greatest(p_last, sent_at)"
    return one_way_known(first, last, "(p_n + 1)", registry)


def tier(three: str, two: str, registry: Registry, position: str) -> str:
    """First tier whose rule holds; tier 1 needs a reply in the sender's own, closed, domain."""
    return (
        f"CASE WHEN {three} THEN 3 WHEN {two} THEN 2 "
        f"WHEN NOT {is_freemail('rd')} AND reply_pos < {position} THEN 1 ELSE 0 END"
    )


def tier_before(registry: Registry = DEFAULT_REGISTRY) -> str:
    """Tier of the sender just before the message, from prior state and activation positions."""
    return tier("pos3 < pos", one_way_known("p_first", "p_last", "p_n", registry), registry, "pos")


def one_way_positions(
    incoming: DataFrame,
    order: list[str],
    *,
    registry: Registry = DEFAULT_REGISTRY,
    hot: HotKeys = NONE_HOT,
    policy: SkewPolicy = DEFAULT_SKEW,
    carry: DataFrame | None = None,
) -> DataFrame:
    """(sender, own_pos2): the first message with which the one-way rule holds."""
    narrow = incoming.select("sender", "t", "msg_id", "sent_at", "pos")
    return one_way_of(prior_state(narrow, order, only=TIMES, hot=hot, policy=policy, carry=carry), registry)


def one_way_of(state: DataFrame, registry: Registry = DEFAULT_REGISTRY) -> DataFrame:
    """The same from messages that have the sender's prior state already."""
    return state.filter(own_included(registry)).groupBy("sender").agg(F.min("pos").alias("own_pos2"))


def join_activations(one_way: DataFrame, credits: DataFrame) -> DataFrame:
    """Per sender: ``pos3`` first credit, ``pos2`` first moment of tier 2 or above."""
    credited = credits.groupBy("sender").agg(F.min("pos").alias("pos3"))
    return one_way.join(credited, "sender", "full").selectExpr(
        "sender", "pos3", "least(own_pos2, pos3) AS pos2"
    )


def activations(incoming: DataFrame, credits: DataFrame, order: list[str], **options) -> DataFrame:
    """Per sender: ``pos3`` first credit, ``pos2`` first moment of tier 2 or above."""
    return join_activations(one_way_positions(incoming, order, **options), credits)


def domain_trust(acts: DataFrame, registry: Registry = DEFAULT_REGISTRY) -> DataFrame:
    """Per domain the first moment one of its senders reached tier 2."""
    return (
        acts.selectExpr(f"{sender_domain(registry)} AS rd", "pos2").groupBy("rd").agg(F.min("pos2").alias("trust_pos"))
    )


def current_tiers(
    incoming: DataFrame,
    credits: DataFrame,
    replies: DataFrame,
    registry: Registry = DEFAULT_REGISTRY,
    *,
    hot: HotKeys = NONE_HOT,
    policy: SkewPolicy = DEFAULT_SKEW,
) -> DataFrame:
    """Tier stored per sender: the rules evaluated at the sender's own last event."""
    seen = incoming.groupBy("sender").agg(
        F.count(F.lit(1)).alias("n"),
        F.expr("min(nullif(sent_at, 0L)) AS first"),
        F.max("sent_at").alias("last"),
        F.max("pos").alias("last_pos"),
    )
    credited = credits.select("sender").distinct().selectExpr("sender", "true AS credited")
    everyone = seen.join(credited, "sender", "full").selectExpr("*", f"{sender_domain(registry)} AS rd")
    known = salted_left_join(
        everyone, replies.select("rd", "reply_pos"), "rd", "sender", hot.get("rd"), policy
    )
    now = tier("credited", one_way_known("first", "last", "n", registry), registry, "last_pos")
    return known.selectExpr("sender", f"{now} AS trust_tier")
