"""The message fact: columns every operator may rely on, and the tables exploded from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wonted.config import DEFAULT_REGISTRY, Registry
from wonted.functions.domains import is_freemail, reg_domain_of_clean
from wonted.functions.position import position
from wonted.functions.text import address_domain, skeleton, skeleton_ascii
from wonted.operators.folding import with_folded, with_names

# Columns of the fact with the type and value used when a source does not have them.
DEFAULTS = {
    "account_id": ("bigint", 1),
    "folder": ("string", "INBOX"),
    "uid": ("bigint", None),
    "message_id": ("string", None),
    "from_display_name": ("string", None),
    "reply_to_email_norm": ("string", None),
    "to_me_directly": ("boolean", False),
    "n_recipients": ("int", None),
    "recipients": ("array<string>", None),
    "sent_hour_local": ("int", None),
    "sent_dow_local": ("int", None),
    "size_bytes": ("bigint", 0),
    "attachments": ("array<struct<mime_type:string,extension:string,size_bytes:bigint>>", None),
    "link_domains": ("map<string,int>", None),
    "links_extracted": ("boolean", True),
    "is_reply": ("boolean", False),
    "thread_id": ("bigint", None),
    "thread_depth": ("int", 0),
    "auth_spf": ("string", None),
    "auth_dkim": ("string", None),
    "auth_dmarc": ("string", None),
}


def prepare(
    messages: DataFrame,
    *,
    order_by: str = "sent_at",
    registry: Registry = DEFAULT_REGISTRY,
    names: bool = True,
) -> DataFrame:
    """Complete a message table with missing columns and the derived ones used by the operators.

    ``order_by`` is "sent_at" to replay history in time order or "msg_id" for order of arrival.
    Without ``names`` the folded display names, which only value counts and shared names need, stay NULL.
    """
    kept = list(messages.columns)
    missing = [f"cast({_value(v)} AS {t}) AS {c}" for c, (t, v) in DEFAULTS.items() if c not in kept]
    t = f"bigint({order_by})"
    m = messages.selectExpr("*", *missing).selectExpr(
        "*",
        "from_email_norm AS sender",
        f"{reg_domain_of_clean(address_domain('from_email_norm'), registry.suffixes)} AS rd",
        f"{reg_domain_of_clean(address_domain('reply_to_email_norm'), registry.suffixes)} AS reply_rd",
        "coalesce(array_size(attachments), 0) AS n_attachments",
        f"{N_LINKS} AS n_links",
        f"{t} AS t",
        f"{position(t, 'bigint(msg_id)')} AS pos",
    )
    return with_names(m) if names else m.selectExpr("*", "string(NULL) AS name_norm", "string(NULL) AS name_skel")


def _value(v) -> str:
    return "NULL" if v is None else repr(v).lower() if isinstance(v, bool) else repr(v)


N_LINKS = "aggregate(coalesce(map_values(link_domains), array()), 0L, (a, x) -> a + x)"


def incoming(facts: DataFrame) -> DataFrame:
    return facts.filter("direction = 'in'")


def outgoing(facts: DataFrame) -> DataFrame:
    return facts.filter("direction = 'out'").withColumn(
        "recipients", F.coalesce("recipients", F.array().cast("array<string>"))
    )


def sender_dimension(facts: DataFrame, registry: Registry = DEFAULT_REGISTRY) -> DataFrame:
    """Every address seen as incoming sender or outgoing recipient, with first and last time.

    Domain columns are computed once per distinct address.
    """
    seen = "if(direction = 'in', array(sender), array_distinct(coalesce(recipients, array())))"
    domain = address_domain("email_norm")
    senders = (
        facts.selectExpr(f"explode({seen}) AS email_norm", "sent_at")
        .groupBy("email_norm")
        .agg(F.min("sent_at").alias("first_seen_at"), F.max("sent_at").alias("last_seen_at"))
        .selectExpr("*", f"{domain} AS domain", f"{reg_domain_of_clean(domain, registry.suffixes)} AS reg_domain")
    )
    return with_folded(
        senders, "reg_domain", "email_norm", {"reg_domain_skeleton": skeleton_ascii("reg_domain")},
        {"reg_domain_skeleton": skeleton("reg_domain")},
    ).selectExpr(
        "email_norm", "domain", "reg_domain", "reg_domain_skeleton",
        f"{is_freemail('reg_domain')} AS is_freemail", "first_seen_at", "last_seen_at",
    )


def message_attachments(facts: DataFrame) -> DataFrame:
    return facts.select("msg_id", F.explode("attachments").alias("a")).select("msg_id", "a.*")


def message_link_domains(facts: DataFrame) -> DataFrame:
    return facts.select("msg_id", F.explode("link_domains").alias("reg_domain", "n"))


def message_recipients(facts: DataFrame) -> DataFrame:
    """Recipients of outgoing mail only, each once per message."""
    return outgoing(facts).select("msg_id", F.explode(F.array_distinct("recipients")).alias("email_norm"))


def assemble_facts(messages: DataFrame, attachments: DataFrame, links: DataFrame) -> DataFrame:
    """Nested facts from the flat message table and its child tables (a message's own rows only)."""
    a = attachments.groupBy("msg_id").agg(
        F.collect_list(F.struct("mime_type", "extension", "size_bytes")).alias("attachments")
    )
    d = links.groupBy("msg_id").agg(
        F.map_from_entries(F.collect_list(F.struct("reg_domain", F.col("n").cast("int")))).alias("link_domains")
    )
    return messages.join(a, "msg_id", "left").join(d, "msg_id", "left")
