"""Full deterministic replay: every profile, tier and score from the message facts in one plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from wonted.config import DEFAULT_REGISTRY, DEFAULT_SKEW, Registry, SkewPolicy
from wonted.operators import baseline, features, gaps, lookalike, relations
from wonted.operators.skew import NONE_HOT, HotKeys, find_hot_keys, salted_left_join
from wonted.plans import reports
from wonted.session import checkpointed
from wonted.sources import facts as facts_

ORDER = ["t", "msg_id"]
MESSAGE = [
    "msg_id", "sender", "rd", "t", "pos", "sent_at", "sent_hour_local", "size_bytes",
    "n_attachments", "n_links", "from_display_name", "name_norm", "name_skel", "reply_rd",
    "reply_to_email_norm", "attachments", "link_domains", "links_extracted", "auth_spf",
    "auth_dkim", "auth_dmarc",
]


@dataclass
class Derived:
    """Everything derived from the facts; the members are lazy."""

    scored: DataFrame
    scores: DataFrame
    features: DataFrame
    credits: DataFrame
    values: DataFrame
    incoming: DataFrame
    replies: DataFrame
    registry: Registry
    hot: HotKeys
    policy: SkewPolicy

    def tiers(self) -> DataFrame:
        return relations.current_tiers(
            self.incoming, self.credits, self.replies, self.registry, hot=self.hot, policy=self.policy
        )

    def sender_profiles(self) -> DataFrame:
        return baseline.sender_profiles(self.incoming, self.credits, self.tiers())

    def domain_profiles(self) -> DataFrame:
        return baseline.domain_profiles(self.incoming, self.replies)

    def listing(self, *, limit: int | None = None, tier: int | None = None) -> DataFrame:
        """``reports.listing`` of the scored messages, which have all its columns: nothing is joined before the top."""
        rows = self.scored.selectExpr(
            *reports.SHOWN, "anomaly_score", f"'{self.registry.version}' AS engine_version",
            *[f"{c} AS {name}" if c in self.scored.columns else f"cast(NULL AS {t}) AS {name}"
              for c, name, t in (("tier", "trust_tier_at_scoring", "int"), ("p_n", "baseline_n", "bigint"))],
        )
        return reports.ranked(
            rows, self.tiers(), limit=limit, tier=tier, registry=self.registry, hot=self.hot.get("sender"), policy=self.policy
        )


def replay(
    facts: DataFrame,
    *,
    registry: Registry = DEFAULT_REGISTRY,
    policy: SkewPolicy = DEFAULT_SKEW,
    hot: HotKeys | None = None,
    cut: Callable[[DataFrame], DataFrame] | None = None,
    names: tuple[str, ...] = features.NAMES,
) -> Derived:
    """Score every incoming message of ``facts`` (see ``facts.prepare``) against the state before it.

    The number of shuffles is fixed: by sender for state, by thread for credits, by message id (never
    skewed) to put columns together, and small ones by domain, name and form.  What several branches read is stored
    once, in the shared folder: the facts, the messages with their sender's prior state (one pass by sender, from which
    activations and silences follow too), credits, activations and value counts.  ``cut`` stores them another way.  ``names`` restricts the work to some features and what they need.
    """
    needs = features.inputs_of(names)
    keep = (cut or checkpointed) if needs else lambda df: df  # rules of a single message read the facts once
    facts = keep(facts)
    if hot is None:
        hot = find_hot_keys(facts, ["sender", "thread_id", "name_skel", "rd"], "sent_at", "msg_id", policy)
    common = {"hot": hot, "policy": policy}
    inc = facts_.incoming(facts).select(*MESSAGE, "message_id", "thread_id", "thread_depth", "sent_dow_local")
    out = facts_.outgoing(facts)
    credits = keep(relations.reply_credits(inc, out, **common))
    replies = relations.domain_replies(credits, registry)
    values, named = baseline.sender_values(inc), baseline.sender_names(inc)
    state, acts = inc.select(*MESSAGE, "message_id"), None
    if needs - {"novelties"}:
        state = baseline.prior_state(state, ORDER, **common)
        if "hours" in needs:
            state = baseline.prior_same_hour(state, ORDER, **common)
        state = keep(state)
        acts = keep(relations.join_activations(relations.one_way_of(state, registry), credits))
    if "novelties" in needs:
        values = keep(values)
    scored = judge(state, replies, acts, values, named, registry=registry, names=names, **common)
    return Derived(
        scored,
        features.message_scores(scored, registry),
        features.score_features(scored, registry, names),
        credits, values.unionByName(named), inc, replies, registry, hot, policy,
    )


def sender_context(
    inc: DataFrame,
    replies: DataFrame,
    acts: DataFrame,
    registry: Registry,
    hot: HotKeys,
    policy: SkewPolicy,
    lookalikes: bool = True,
) -> DataFrame:
    """Per sender the positions that concern it: its own credit and everything about its domain.

    Looked up once per sender, so a domain shared by very many messages is joined on far fewer rows.
    """
    senders = inc.select("sender", "rd").distinct().join(acts.select("sender", "pos3"), "sender", "left")
    per_domain = replies.select("rd", "reply_pos")
    if lookalikes:
        trust = relations.domain_trust(acts, registry)
        domains = inc.select("rd").distinct().join(trust, "rd", "full")
        alike = lookalike.lookalikes(domains, registry)
        per_domain = domains.join(per_domain, "rd", "left").join(alike, "rd", "left")
    return salted_left_join(senders, per_domain, "rd", "sender", hot.get("rd"), policy).drop("rd")


def judge(
    state: DataFrame,
    replies: DataFrame,
    acts: DataFrame | None,
    values: DataFrame,
    named: DataFrame,
    *,
    registry: Registry = DEFAULT_REGISTRY,
    hot: HotKeys = NONE_HOT,
    policy: SkewPolicy = DEFAULT_SKEW,
    names: tuple[str, ...] = features.NAMES,
) -> DataFrame:
    """Messages with prior state, context, novelties, tier, features and score.

    Only the inputs that the wanted features read are computed and joined.
    """
    common, needs = {"hot": hot, "policy": policy}, features.inputs_of(names)
    judged = state
    if needs & {"tier", "context"}:
        context = sender_context(state, replies, acts, registry, hot, policy, "context" in needs)
        judged = salted_left_join(judged, context, "sender", "msg_id", hot.get("sender"), policy)
    if "owners" in needs:
        owners = lookalike.name_owners(named, acts)
        judged = salted_left_join(judged, owners, "name_skel", "msg_id", hot.get("name_skel"), policy)
    if "novelties" in needs:
        judged = judged.join(baseline.novelties(values, ORDER, **common), "msg_id", "left")
    if "gaps" in needs:
        times = state.select("sender", "t", "msg_id", "sent_at", *baseline.TIMES)
        judged = judged.join(gaps.median_gaps(times, registry=registry, **common), "msg_id", "left")
    if "tier" in needs:
        judged = judged.selectExpr("*", f"{relations.tier_before(registry)} AS tier")
    return features.with_features(judged, registry, names)
