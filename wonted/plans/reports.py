"""Read side: ranked listing, status counts, sender detail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wonted.config import DEFAULT_REGISTRY, DEFAULT_SKEW, TIER_LABELS, Registry, SkewPolicy
from wonted.operators.skew import salted_left_join


def tier_label(tier: str) -> str:
    whens = " ".join(f"WHEN {k} THEN '{v}'" for k, v in TIER_LABELS.items())
    return f"CASE {tier} {whens} END"


def severity(score: str) -> str:
    return f"CASE WHEN {score} >= 30 THEN 'hi' WHEN {score} >= 10 THEN 'mid' ELSE 'lo' END"


#: Columns of a message that a listing shows.
SHOWN = ("msg_id", "message_id", "sender", "from_display_name", "sent_at", "n_attachments", "n_links", "size_bytes")


def listing(incoming: DataFrame, scores: DataFrame, tiers: DataFrame, **options) -> DataFrame:
    """``ranked`` of stored messages and stored scores.

    Without a tier filter the top is taken from (score, time, id) alone, and only its rows, at most
    ``registry.listing_max``, are looked up.
    """
    if options.get("tier") is not None:
        return ranked(incoming.select(*SHOWN).join(scores, "msg_id"), tiers, **options)
    rows = incoming.select("msg_id", "sent_at").join(scores.select("msg_id", "anomaly_score"), "msg_id")
    top = F.broadcast(_top(rows, _size(**options)).select("msg_id"))  # at most 1000 ids
    rows = incoming.select(*SHOWN).join(top, "msg_id", "left_semi").join(scores.join(top, "msg_id", "left_semi"), "msg_id")
    return ranked(rows, tiers, **options)


def _size(limit: int | None = None, registry: Registry = DEFAULT_REGISTRY, **_) -> int:
    return min(registry.listing_default if limit is None else limit, registry.listing_max)


def _top(rows: DataFrame, k: int) -> DataFrame:
    return rows.orderBy(F.desc("anomaly_score"), F.desc("sent_at"), "msg_id").limit(k)


def ranked(
    rows: DataFrame,
    tiers: DataFrame,
    *,
    limit: int | None = None,
    tier: int | None = None,
    registry: Registry = DEFAULT_REGISTRY,
    hot: DataFrame | None = None,
    policy: SkewPolicy = DEFAULT_SKEW,
) -> DataFrame:
    """Highest scores first, newest first among equals; a top-k, so no full sort takes place.

    With a tier filter the sender's current tier decides, else the tier at scoring.  Without one the top is taken
    before the tiers are looked up, and only tiers of its senders are worked out.
    """
    k = _size(limit, registry)
    if tier is None:
        rows = _top(rows, k)
        few = F.broadcast(rows.select("sender").distinct())  # at most 1000
        joined = rows.join(F.broadcast(tiers.join(few, "sender", "left_semi")), "sender", "left")
    else:
        joined = salted_left_join(rows, tiers, "sender", "msg_id", hot, policy)
    joined = joined.selectExpr("*", "coalesce(trust_tier, trust_tier_at_scoring) AS tier")
    if tier is not None:
        joined = joined.filter(f"tier = {int(tier)}")
    return _top(joined, k).selectExpr(
        "msg_id", "message_id", "sender AS from_email_norm", "from_display_name", "sent_at",
        "n_attachments", "n_links", "size_bytes", "anomaly_score", "tier",
        f"{tier_label('tier')} AS tier_label", f"{severity('anomaly_score')} AS severity",
        "trust_tier_at_scoring", "baseline_n", "engine_version",
    )


def listing_details(rows: DataFrame, features: DataFrame) -> DataFrame:
    """Listing rows with their features, largest contribution first (at most fifteen per row)."""
    mine = features.join(F.broadcast(rows.select("msg_id")), "msg_id", "left_semi")  # at most 1000 ids
    nested = mine.groupBy("msg_id").agg(
        F.expr(
            "transform(array_sort(collect_list(struct(-contribution AS _by, feature, raw_value, weight, "
            "contribution, explanation))), x -> struct(x.feature, x.raw_value, x.weight, x.contribution, "
            "x.explanation)) AS features"
        )
    )
    return rows.join(nested, "msg_id", "left").withColumn(
        "features", F.coalesce("features", F.array())
    )


def listing_json(detailed: DataFrame) -> DataFrame:
    """One JSON document per listing row."""
    return detailed.select("msg_id", F.to_json(F.struct("*")).alias("document"))


def status(facts: DataFrame, senders: DataFrame) -> DataFrame:
    """One row: messages, incoming messages, known senders."""
    parts = facts.selectExpr("1L AS messages", "if(direction = 'in', 1L, 0L) AS incoming", "0L AS senders").unionByName(
        senders.selectExpr("0L AS messages", "0L AS incoming", "1L AS senders")
    )
    return parts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in parts.columns])


def sender_detail(senders: DataFrame, profiles: DataFrame, email: str | None = None) -> DataFrame:
    """Senders with their profile, NULL where there is none; no row for an unknown address."""
    who = senders if email is None else senders.filter(F.col("email_norm") == email)
    wanted = profiles.selectExpr(
        "sender AS email_norm", "n_messages", "n_replied_threads", "n_user_initiated", "trust_tier",
        "n_with_attachments", "n_with_links", "first_msg_at", "last_msg_at",
    )
    return who.join(wanted, "email_norm", "left")
