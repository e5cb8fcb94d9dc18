"""Per-sender state before each message, values seen per sender, and final profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wonted.config import DEFAULT_SKEW, SkewPolicy
from wonted.functions.domains import is_freemail
from wonted.functions.position import id_of, time_of
from wonted.functions.stats import LOG_DIGITS, histogram, log_size, m2_of, mean_of, squared, units
from wonted.operators.running import running
from wonted.operators.skew import NONE_HOT, HotKeys



def own_state() -> dict[str, tuple[str, str]]:
    """What one message adds to its sender's state; every entry merges by sum, min or max."""
    size = units(log_size("size_bytes"), LOG_DIGITS)
    return {
        "p_n": ("count", "true"),
        "p_first": ("min", "nullif(sent_at, 0L)"),
        "p_last": ("max", "sent_at"),
        "p_size": ("sum", size),
        "p_size2": ("sum", squared(size)),
        "p_links": ("sum", "n_links"),
        "p_links2": ("sum", squared("n_links")),
        "p_hours": ("count", "sent_hour_local IS NOT NULL"),
        "p_att": ("count", "n_attachments > 0"),
    }


TIMES = ("p_n", "p_first", "p_last")


def prior_state(
    incoming: DataFrame,
    order: list[str],
    *,
    only: tuple[str, ...] | None = None,
    hot: HotKeys = NONE_HOT,
    policy: SkewPolicy = DEFAULT_SKEW,
    carry: DataFrame | None = None,
) -> DataFrame:
    """Add the sender's state before each message (``only`` some of its columns)."""
    aggs = {k: v for k, v in own_state().items() if only is None or k in only}
    return running(
        incoming, ["sender"], order, aggs, hot=hot.get("sender"), policy=policy, carry=carry
    )


def prior_same_hour(
    incoming: DataFrame,
    order: list[str],
    *,
    hot: HotKeys = NONE_HOT,
    policy: SkewPolicy = DEFAULT_SKEW,
    carry: DataFrame | None = None,
) -> DataFrame:
    """Add ``p_hour``: earlier messages of the sender at the same hour of the sender's clock."""
    return running(
        incoming,
        ["sender", "sent_hour_local"],
        order,
        {"p_hour": ("count", "true")},
        hot=hot.get("sender"),
        policy=policy,
        carry=carry,
    )


def value_rows(incoming: DataFrame) -> DataFrame:
    """One row per (message, kind, value): link domains, attachment types and Reply-To addresses, so
    that one aggregation serves all three."""

    def entry(kind, a, b="''", n="1L"):
        return f"named_struct('kind', '{kind}', 'a', {a}, 'b', {b}, 'n', bigint({n}))"

    entries = ", ".join(
        [
            f"transform(coalesce(map_entries(link_domains), array()), e -> {entry('link', 'e.key', n='e.value')})",
            "transform(coalesce(attachments, array()), x -> "
            + entry("attachment", "coalesce(x.extension, '')", "x.mime_type") + ")",
            f"array({entry('reply_to', 'reply_to_email_norm')})",
        ]
    )
    return incoming.selectExpr(
        "sender", "pos", f"inline(filter(concat({entries}), e -> e.a IS NOT NULL))"
    )


def _first_and_count(rows: DataFrame) -> DataFrame:
    return rows.groupBy("sender", "kind", "a", "b").agg(
        F.sum("n").alias("n"), F.min("pos").alias("first_pos")
    )


def sender_values(incoming: DataFrame) -> DataFrame:
    """(sender, kind, a, b) with its count and first position, for links, attachments, Reply-To."""
    return _first_and_count(value_rows(incoming))


def sender_names(incoming: DataFrame) -> DataFrame:
    """The same for display names: a is the name, b its skeleton."""
    return _first_and_count(
        incoming.filter("name_norm IS NOT NULL").selectExpr(
            "sender", "pos", "'name' AS kind", "name_norm AS a", "name_skel AS b", "1L AS n"
        )
    )


def novelties(
    values: DataFrame,
    order: list[str],
    *,
    hot: HotKeys = NONE_HOT,
    policy: SkewPolicy = DEFAULT_SKEW,
    carry: DataFrame | None = None,
) -> DataFrame:
    """Per message, the values its sender uses for the first time with it.

    A value is new exactly in the message at its first position, so no prior sets are carried.
    ``values`` holds first uses; ``carry`` the number of link domains known per sender before.
    """

    def of(kind, value):
        return F.expr(f"array_sort(collect_set(if(kind = '{kind}', {value}, NULL)))")

    per_message = (
        values.groupBy("sender", F.col("first_pos").alias("pos"))
        .agg(
            of("link", "a").alias("new_links"),
            of("attachment", "if(a <> '', concat('.', a), b)").alias("new_attachments"),
            F.expr("max(kind = 'reply_to') AS new_reply_to"),
        )
        .selectExpr("*", f"{time_of('pos')} AS t", f"{id_of('pos')} AS msg_id")
    )
    return running(
        per_message,
        ["sender"],
        order,
        {"p_link_domains": ("sum", "bigint(size(new_links))")},
        hot=hot.get("sender"),
        policy=policy,
        carry=carry,
    ).selectExpr(
        "msg_id",
        "new_links",
        "new_attachments",
        "new_reply_to",
        "coalesce(p_link_domains, 0L) AS p_link_domains",
    )


def thread_counts(incoming: DataFrame) -> DataFrame:
    """Per sender the messages that opened a thread for it: those at the earliest time it has in the
    thread (ties all count)."""
    at = incoming.groupBy("sender", "thread_id", "sent_at").agg(F.count(F.lit(1)).alias("n"))
    return (
        at.groupBy("sender", "thread_id")
        .agg(F.min_by("n", "sent_at").alias("n"))
        .groupBy("sender")
        .agg(F.sum("n").alias("n_threads"))
    )


def sender_hours(incoming: DataFrame, column: str) -> DataFrame:
    return (
        incoming.filter(F.col(column).isNotNull())
        .groupBy("sender", column)
        .agg(F.count(F.lit(1)).alias("n"))
    )


def sender_profiles(incoming: DataFrame, credits: DataFrame, tiers: DataFrame) -> DataFrame:
    """Final state per sender with at least one incoming message or credit.

    Every group-by here combines before the shuffle, so a dominating sender costs one partial row per
    task.  Histograms are collected from at most 24 and 7 pre-counted rows.
    """
    size = units(log_size("size_bytes"), LOG_DIGITS)
    base = incoming.groupBy("sender").agg(
        *[
            F.expr(text)
            for text in (
                "count(*) AS n_messages",
                f"sum({size}) AS _size",
                f"sum({squared(size)}) AS _size2",
                "sum(n_links) AS _links",
                f"sum({squared('n_links')}) AS _links2",
                "count_if(n_attachments > 0) AS n_with_attachments",
                "count_if(n_links > 0) AS n_with_links",
                "count_if(reply_to_email_norm IS NOT NULL) AS n_replyto_divergent",
                "coalesce(min(nullif(sent_at, 0L)), 0L) AS first_msg_at",
                "max(sent_at) AS last_msg_at",
                "max(thread_depth) AS max_thread_depth",
            )
        ]
    )
    moments = {"log_size": ("_size", "_size2", LOG_DIGITS), "links": ("_links", "_links2", 0)}
    for name, (total, squares, digits) in moments.items():
        base = base.selectExpr(
            "*", f"{mean_of(total, 'n_messages', digits)} AS {name}_mean",
            f"coalesce({m2_of(total, squares, 'n_messages', digits)}, 0D) AS {name}_m2",
        ).drop(total, squares)

    def bins(column, size_, name):
        counts = f"map_from_entries(collect_list(struct(int({column}), n)))"
        return (
            sender_hours(incoming, column)
            .groupBy("sender")
            .agg(F.expr(f"{histogram(counts, size_)} AS {name}"))
        )

    credited = credits.groupBy("sender").agg(
        F.expr("count_if(kind = 'replied') AS n_replied_threads"),
        F.expr("count_if(kind = 'initiated') AS n_user_initiated"),
    )
    joined = (
        base.join(thread_counts(incoming), "sender", "left")
        .join(bins("sent_hour_local", 24, "hour_histogram"), "sender", "left")
        .join(bins("sent_dow_local", 7, "dow_histogram"), "sender", "left")
        .join(credited, "sender", "full")
        .join(tiers, "sender", "left")
    )
    zeros = [
        "n_messages", "n_threads", "n_replied_threads", "n_user_initiated", "n_with_attachments",
        "n_with_links", "n_replyto_divergent", "max_thread_depth",
    ]

    def blank(n):
        return F.array_repeat(F.lit(0).cast("bigint"), n)

    return joined.withColumns(
        {c: F.coalesce(c, F.lit(0)).cast("bigint") for c in zeros}
        | {
            "hour_histogram": F.coalesce("hour_histogram", blank(24)),
            "dow_histogram": F.coalesce("dow_histogram", blank(7)),
        }
    )


def domain_profiles(incoming: DataFrame, domain_replies: DataFrame) -> DataFrame:
    """Totals per registrable domain; senders are counted from per-sender partial rows."""
    per_sender = incoming.groupBy("rd", "sender").agg(
        F.count(F.lit(1)).alias("n"), F.min("sent_at").alias("lo"), F.max("sent_at").alias("hi")
    )
    return (
        per_sender.groupBy("rd")
        .agg(
            F.count(F.lit(1)).alias("n_senders"),
            F.sum("n").alias("n_messages"),
            F.min("lo").alias("first_seen_at"),
            F.max("hi").alias("last_seen_at"),
        )
        .join(domain_replies.select("rd", "n_replied_threads"), "rd", "left")
        .select(
            F.col("rd").alias("reg_domain"),
            "n_senders",
            "n_messages",
            F.coalesce("n_replied_threads", F.lit(0).cast("bigint")).alias("n_replied_threads"),
            F.expr(is_freemail("rd")).alias("is_freemail"),
            "first_seen_at",
            "last_seen_at",
        )
    )
