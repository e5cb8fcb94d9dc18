"""Attaching messages to threads by Message-ID, In-Reply-To and References."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wonted.config import DEFAULT_SKEW, SkewPolicy
from wonted.operators.skew import find_hot_keys, salted_left_join
from wonted.session import checkpointed

# In-Reply-To first, then References from the nearest to the oldest.
ANCESTORS = (
    "concat(if(in_reply_to IS NULL, cast(array() AS array<string>), array(in_reply_to)), "
    "reverse(coalesce(references, cast(array() AS array<string>))))"
)
ROOT_KEY = "coalesce(get(references, 0), message_id)"
ROOT_DEPTH = "if(coalesce(array_size(references), 0) > 0, 1, 0)"


def parents(
    messages: DataFrame, known: DataFrame | None = None, policy: SkewPolicy = DEFAULT_SKEW
) -> DataFrame:
    """(msg_id, parent): the first ancestor in order that had arrived before the message.

    Of several rows with one Message-ID the earliest counts.  ``known`` holds (message_id, msg_id) of
    messages stored earlier.
    """
    ids = messages.select("message_id", "msg_id")
    if known is not None:
        ids = ids.unionByName(known.select("message_id", "msg_id"))
    arrived = (
        ids.filter("message_id IS NOT NULL")
        .groupBy(F.col("message_id").alias("ref"))
        .agg(F.min("msg_id").alias("parent"))
    )
    wanted = messages.selectExpr("msg_id", f"posexplode({ANCESTORS}) AS (at, ref)")
    hot = find_hot_keys(wanted, ["ref"], "msg_id", "msg_id", policy).get("ref")
    return (
        salted_left_join(wanted, arrived, "ref", "msg_id", hot, policy)
        .filter("parent < msg_id")
        .groupBy("msg_id")
        .agg(F.min_by("parent", "at").alias("parent"))
    )


def resolve_threads(
    messages: DataFrame,
    *,
    known: DataFrame | None = None,
    known_roots: DataFrame | None = None,
    policy: SkewPolicy = DEFAULT_SKEW,
) -> DataFrame:
    """(msg_id, thread_id, thread_depth, root_key) for messages with message_id, in_reply_to, references.

    A message without a known ancestor belongs to the thread named by its oldest reference or itself;
    a thread's id is the msg_id of the message that opened it.  Others follow parent pointers, which
    are doubled every round, so a chain of length n takes about log2(n) rounds; each round stores the messages still
    open in the shared folder.  ``known`` (message_id, msg_id, thread_id, thread_depth) and ``known_roots``
    (root_key, thread_id) continue from earlier batches.
    """
    up = parents(messages, known, policy)
    nodes = messages.selectExpr("msg_id", f"{ROOT_KEY} AS root_key", f"{ROOT_DEPTH} AS base").join(
        up, "msg_id", "left"
    )
    opened = nodes.filter("parent IS NULL AND root_key IS NOT NULL").select(
        "root_key", F.col("msg_id").alias("thread_id")
    )
    if known_roots is not None:
        opened = opened.unionByName(known_roots.select("root_key", "thread_id"))
    threads = opened.groupBy("root_key").agg(F.min("thread_id").alias("thread_id"))
    roots = nodes.filter("parent IS NULL")
    hot = find_hot_keys(roots, ["root_key"], "msg_id", "msg_id", policy).get("root_key")
    done = salted_left_join(roots, threads, "root_key", "msg_id", hot, policy).selectExpr(
        "msg_id", "cast(NULL AS bigint) AS at", "0 AS hops",
        "coalesce(thread_id, msg_id) AS thread_id", "base AS depth", "root_key",
    )
    climbing = nodes.filter("parent IS NOT NULL").selectExpr(
        "msg_id", "parent AS at", "1 AS hops", "cast(NULL AS bigint) AS thread_id", "0 AS depth",
        "cast(NULL AS string) AS root_key",
    )
    state = done.unionByName(climbing)
    if known is not None:
        # only stored messages that are somebody's parent take part
        stored = known.join(up.selectExpr("parent AS msg_id").distinct(), "msg_id", "left_semi")
        state = state.unionByName(
            stored.selectExpr(
                "msg_id", "cast(NULL AS bigint) AS at", "0 AS hops", "thread_id",
                "thread_depth AS depth", "cast(NULL AS string) AS root_key",
            )
        )
    state = checkpointed(state)
    settled, open_ = state.filter("at IS NULL"), state.filter("at IS NOT NULL")
    while not open_.isEmpty():
        moved = checkpointed(_double(settled, open_, policy))  # a round writes the open rows only
        settled, open_ = settled.unionByName(moved.filter("at IS NULL")), moved.filter("at IS NOT NULL")
    found = settled.selectExpr("msg_id", "thread_id", "depth AS thread_depth", "root_key")
    if known is not None:
        found = found.join(messages.select("msg_id"), "msg_id", "left_semi")
    return found


def _double(settled: DataFrame, moving: DataFrame, policy: SkewPolicy) -> DataFrame:
    """Open rows with the pointer of the row they point to, or settled with it."""
    hot = find_hot_keys(moving, ["at"], "msg_id", "msg_id", policy).get("at")
    target = settled.unionByName(moving).selectExpr(
        "msg_id AS at", "at AS n_at", "hops AS n_hops", "thread_id AS n_thread", "depth AS n_depth"
    )
    return salted_left_join(
        moving.select("msg_id", "at", "hops"), target, "at", "msg_id", hot, policy
    ).selectExpr(
        "msg_id", "n_at AS at", "hops + n_hops AS hops", "n_thread AS thread_id",
        "if(n_at IS NULL, n_depth + hops, 0) AS depth", "cast(NULL AS string) AS root_key",
    )
