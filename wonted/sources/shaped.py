"""Views that give general tables (events, orders, conversations) the shape of message facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Sender domains by user_id % 10.
EVENT_DOMAINS = (
    "north-ford.com", "north-f0rd.com", "north-frod.com", "quayside.com", "leadmill.io",
    "gmail.com", "trader.io", "timberyard.io", "savings-note.com", "faraway.org",
)


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def mail_events(events: DataFrame) -> DataFrame:
    """Events as messages: one sender per user, purchases of every third user go out to that user."""
    user, kind = F.col("user_id"), F.col("event_type")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    domains = F.array(*[F.lit(d) for d in EVENT_DOMAINS])
    email = F.concat(
        F.lit("u"), user.cast("string"), F.lit("@"), F.get(domains, (user % 10).cast("int"))
    )
    out = (kind == "purchase") & (user % 3 == 0)
    ext = F.get(F.array(*[F.lit(x) for x in ("pdf", "zip", "docx", "png")]), k % 4)
    attachment = F.struct(
        F.concat(F.lit("application/"), ext).alias("mime_type"),
        ext.alias("extension"),
        F.lit(None).cast("bigint").alias("size_bytes"),
    )
    links = F.create_map(F.concat(F.lit("site"), (k % 30).cast("string"), F.lit(".net")), k % 4)
    return events.select(
        F.col("event_id").alias("msg_id"),
        F.unix_timestamp("ts").alias("sent_at"),
        F.hour("ts").alias("sent_hour_local"),
        F.weekday("ts").alias("sent_dow_local"),
        email.alias("from_email_norm"),
        F.concat(F.lit("user "), (user % 40).cast("string")).alias("from_display_name"),
        F.when(out, "out").otherwise("in").alias("direction"),
        F.when(out, F.array(email)).alias("recipients"),
        (user * 10 + k % 5).alias("thread_id"),
        (F.floor(F.col("value") * 100) + 1).cast("bigint").alias("size_bytes"),
        F.when((kind == "click") & (k % 4 > 0), links).alias("link_domains"),
        F.when(kind == "signup", F.array(attachment)).alias("attachments"),
        F.when(k % 25 == 0, F.concat(F.lit("r"), k.cast("string"), F.lit("@elsewhere.net"))).alias(
            "reply_to_email_norm"
        ),
        F.when(k % 50 == 1, "fail").otherwise("pass").alias("auth_dmarc"),
    )


def mail_orders(orders: DataFrame) -> DataFrame:
    """Orders as messages of their customers over several years."""
    return orders.select(
        F.col("o_orderkey").alias("msg_id"),
        F.unix_timestamp("o_orderdate").alias("sent_at"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit("@orders.example.com")).alias(
            "from_email_norm"
        ),
        F.lit("in").alias("direction"),
    )


def mail_conversations(conversations: DataFrame) -> DataFrame:
    """Conversations as reply chains between one peer and us."""
    conv, turn = F.col("conv_id"), F.col("turn")

    def ref(t):
        return F.concat(F.lit("<"), conv.cast("string"), F.lit("."), t.cast("string"), F.lit(">"))

    peer = F.concat(F.lit("peer"), conv.cast("string"), F.lit("@quayside.com"))
    out = F.col("role") == "assistant"
    return conversations.select(
        (conv * 1000 + turn).alias("msg_id"),
        (conv * 1000000 + turn * 60).alias("sent_at"),
        peer.alias("from_email_norm"),
        F.when(out, "out").otherwise("in").alias("direction"),
        F.when(out, F.array(peer)).alias("recipients"),
        conv.alias("thread_id"),
        ref(turn).alias("message_id"),
        F.when(turn > 0, ref(turn - 1)).alias("in_reply_to"),
        F.array().cast("array<string>").alias("references"),
    )
