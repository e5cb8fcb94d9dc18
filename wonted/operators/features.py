"""The fifteen scoring features, the score, and its long form.

Each rule is a pair of SQL texts over one judged message: the raw value (NULL when the rule does not
apply) and the explanation.  Columns: the message; p_* the sender's prior state; pos3, reply_pos,
trust_pos, look0..2, owner1..2 activation positions; new_* first uses; tier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from wonted.config import DEFAULT_REGISTRY, FEATURES, Registry
from wonted.functions.domains import reg_domain_of_clean
from wonted.functions.sql import say
from wonted.functions.stats import LOG_DIGITS, confidence, fired, hour_rarity, log_size, mean_of, ramp, std_of
from wonted.functions.text import address_domain, emails_in_text, format_size, one_decimal

NAMES = tuple(n for n, _, _ in FEATURES)


def when(condition: str, value: str) -> str:
    return f"CASE WHEN {condition} THEN {value} END"


def lookalike_domain(r: Registry):
    unknown = "coalesce(trust_pos < pos, false) = false"
    raw = " ".join(
        f"WHEN {unknown} AND look{i}.pos < pos THEN {v}D" for i, v in ((0, 1.0), (1, 0.9), (2, 0.6))
    )
    target = (
        "CASE WHEN look0.pos < pos THEN look0.target WHEN look1.pos < pos THEN look1.target "
        "ELSE look2.target END"
    )
    return f"CASE {raw} END", say("domain '", "=rd", "' resembles known domain '", f"={target}", "'")


def display_name_collision(r: Registry):
    other = "if(owner1.sender <> sender, owner1, owner2)"
    hit = f"length(name_norm) >= {r.name_min_len} AND {other}.pos < pos"
    words = say(
        "display name '", "=from_display_name", "' matches known contact <", f"={other}.sender",
        "> but address is <", "=sender", ">",
    )
    return when(hit, "1D"), words


def auth_fail(r: Registry):
    both = "auth_dkim = 'fail' AND auth_spf IN ('fail', 'softfail')"

    def pick(strict, two, soft):
        return (
            f"CASE WHEN auth_dmarc = 'fail' THEN {strict} WHEN {both} THEN {two} "
            f"WHEN auth_spf = 'softfail' THEN {soft} END"
        )

    return pick("1D", "0.8D", "0.4D"), pick(
        "'DMARC failed for sending domain'",
        "'DKIM and SPF both failed'",
        "'SPF softfail for sending domain'",
    )


def reply_to_divergence(r: Registry):
    words = say(
        "replies redirect to <", "=reply_to_email_norm", ">, never seen from this sender in ",
        "=p_n", " messages",
    )
    return when("tier >= 2 AND reply_rd <> rd AND new_reply_to", "1D"), words


def embedded_addr_mismatch(r: Registry):
    domain = reg_domain_of_clean(address_domain("e"), r.suffixes)
    first = f"get(filter({emails_in_text('from_display_name')}, e -> {domain} <> rd), 0)"
    words = say("display name shows '", f"={first}", "' but real sender is <", "=sender", ">")
    # the cheap test keeps ordinary names away from the pattern
    return when(f"instr(from_display_name, '@') > 0 AND {first} IS NOT NULL", "1D"), words


def behavioral(r: Registry) -> str:
    return f"tier >= 2 AND p_n >= {r.min_baseline}"


def cold(r: Registry) -> str:
    return f"tier <= 1 AND p_n < {r.min_baseline}"


def first_attachment_ever(r: Registry):
    kinds = "transform(attachments, a -> if(a.extension <> '', a.extension, a.mime_type))"
    shown = (
        f"array_join(transform(array_sort(array_distinct({kinds})), "
        "e -> if(contains(e, '.') OR contains(e, '/'), e, concat('.', e))), ', ')"
    )
    hit = f"{behavioral(r)} AND n_attachments > 0 AND p_att = 0"
    words = say(
        "first attachment of any kind (", f"={shown}", ") in ", "=p_n", " messages from this sender"
    )
    return when(hit, confidence("p_n", r)), words


def attachment_type_novelty(r: Registry):
    hit = f"{behavioral(r)} AND p_att > 0 AND size(new_attachments) > 0"
    words = say(
        "first ", "=array_join(new_attachments, ', ')", " from this sender in ", "=p_n", " messages"
    )
    return when(hit, confidence("p_n", r)), words


def link_domain_novelty(r: Registry):
    hit = f"{behavioral(r)} AND links_extracted AND size(new_links) > 0"
    words = say(
        "links to ", "=array_join(slice(new_links, 1, 3), ', ')",
        "=if(size(new_links) > 3, ' (+more)', '')", ", never linked before (", "=p_link_domains",
        " prior link domains)",
    )
    return when(hit, f"size(new_links) / size(link_domains) * {confidence('p_n', r)}"), words


def send_hour_anomaly(r: Registry):
    hit = f"{behavioral(r)} AND sent_hour_local IS NOT NULL AND p_hours >= {r.min_baseline}"
    words = say(
        "sent at ", "=lpad(cast(sent_hour_local AS string), 2, '0')", ":00 sender-local; ", "=p_hour",
        " of ", "=p_hours", " prior messages at this hour",
    )
    return when(hit, hour_rarity("p_hour", "p_hours", r)), words


def link_density_anomaly(r: Registry):
    mean = mean_of("p_links", "p_n")
    std = f"greatest({std_of('p_links', 'p_links2', 'p_n')}, {r.links_std_floor}D)"
    words = say(
        "=n_links", " links; sender's typical is ", f"={one_decimal(mean)}", " ± ", f"={one_decimal(std)}"
    )
    return when(f"{behavioral(r)} AND n_links > 0", ramp(f"((n_links - {mean}) / {std})", r.links_z)), words


def size_anomaly(r: Registry):
    mean = mean_of("p_size", "p_n", LOG_DIGITS)
    std = f"greatest({std_of('p_size', 'p_size2', 'p_n', LOG_DIGITS)}, {r.size_std_floor}D)"
    z = f"(abs({log_size('size_bytes')} - {mean}) / {std})"
    words = say(
        f"={format_size('size_bytes')}", " message; sender's typical is ",
        f"={format_size(f'cast(exp({mean}) AS bigint)')}",
    )
    return when(behavioral(r), ramp(z, r.size_z)), words


def dormant_resurrection(r: Registry):
    """The gap part of the rule; the score also asks for another fired feature."""
    hit = (
        f"{behavioral(r)} AND gap >= {r.dormant_gap} AND median_gap > 0 "
        f"AND gap > {r.dormant_multiple} * median_gap"
    )
    return when(hit, "1D"), say("first message in ", "=gap div 86400", " days, combined with other anomalies")


SCALE = "if(p_n = 0, 1D, 0.5D)"
WHO = (
    "if(p_n = 0, 'a never-seen sender', "
    "concat('a barely-known sender (', cast(p_n AS string), ' prior messages)'))"
)


def cold_attachment(r: Registry):
    return when(f"{cold(r)} AND n_attachments > 0", SCALE), say("attachment from ", f"={WHO}")


def cold_links(r: Registry):
    return when(f"{cold(r)} AND n_links > 0", SCALE), say("=n_links", " link(s) from ", f"={WHO}")


def cold_replyto(r: Registry):
    words = say(f"={WHO}", " redirects replies to <", "=reply_to_email_norm", ">")
    return when(f"{cold(r)} AND reply_rd <> rd", SCALE), words


RULES = {
    f.__name__: f
    for f in (
        lookalike_domain, display_name_collision, auth_fail, reply_to_divergence,
        embedded_addr_mismatch, attachment_type_novelty, first_attachment_ever,
        link_domain_novelty, send_hour_anomaly, link_density_anomaly, size_anomaly,
        dormant_resurrection, cold_attachment, cold_links, cold_replyto,
    )
}


# What each rule reads besides the message and the sender's running state.
INPUTS = {
    "lookalike_domain": {"context"},
    "display_name_collision": {"owners"},
    "auth_fail": set(),
    "reply_to_divergence": {"tier", "novelties"},
    "embedded_addr_mismatch": set(),
    "attachment_type_novelty": {"tier", "state", "novelties"},
    "first_attachment_ever": {"tier", "state"},
    "link_domain_novelty": {"tier", "state", "novelties"},
    "send_hour_anomaly": {"tier", "state", "hours"},
    "link_density_anomaly": {"tier", "state"},
    "size_anomaly": {"tier", "state"},
    "dormant_resurrection": {"tier", "state", "gaps"},
    "cold_attachment": {"tier", "state"},
    "cold_links": {"tier", "state"},
    "cold_replyto": {"tier", "state"},
}


def inputs_of(names) -> set:
    return set().union(*(INPUTS[n] for n in names))


def feature(name: str, registry: Registry = DEFAULT_REGISTRY) -> list[str]:
    """SQL texts ``raw_<name>`` and ``explain_<name>`` of one rule taken by itself."""
    raw, words = RULES[name](registry)
    return [f"{fired(raw)} AS raw_{name}", f"{words} AS explain_{name}"]


def with_features(
    judged: DataFrame, registry: Registry = DEFAULT_REGISTRY, names: tuple[str, ...] = NAMES
) -> DataFrame:
    """Add raw_<feature>, explain_<feature> and anomaly_score for the given features."""
    raws = judged.selectExpr("*", *[text for n in names for text in feature(n, registry)])
    dormant = "raw_dormant_resurrection"
    others = [f"raw_{n}" for n, _, g in FEATURES if g != "cold" and n in names and f"raw_{n}" != dormant]
    if others and dormant[4:] in names:
        gated = f"if(coalesce({', '.join(others)}) IS NULL, NULL, {dormant}) AS {dormant}"
        raws = raws.selectExpr(*[gated if c == dormant else c for c in raws.columns])
    points = " + ".join(f"coalesce(raw_{n}, 0D) * {float(registry.weights[n])}D" for n in names)
    return raws.selectExpr(
        "*", f"least(round({points}, 4), {float(registry.max_score)}D) AS anomaly_score"
    )


def message_scores(scored: DataFrame, registry: Registry = DEFAULT_REGISTRY) -> DataFrame:
    """One row per incoming message; tier and baseline where the features needed them."""
    columns = {"tier": "trust_tier_at_scoring", "p_n": "baseline_n"}
    return scored.selectExpr(
        "msg_id",
        f"'{registry.version}' AS engine_version",
        *[f"{c} AS {name}" for c, name in columns.items() if c in scored.columns],
        "anomaly_score",
    )


def score_features(
    scored: DataFrame, registry: Registry = DEFAULT_REGISTRY, names: tuple[str, ...] = NAMES
) -> DataFrame:
    """One row per fired feature; their contributions add up to the score below its cap."""
    rows = ", ".join(
        f"if(raw_{n} IS NULL, NULL, named_struct('feature', '{n}', 'raw_value', raw_{n}, "
        f"'weight', {float(registry.weights[n])}D, "
        f"'contribution', round(raw_{n} * {float(registry.weights[n])}D, 4), "
        f"'explanation', explain_{n}))"
        for n in names
    )
    return scored.selectExpr("msg_id", f"inline(array_compact(array({rows})))")


def stale_scores(scores: DataFrame, registry: Registry = DEFAULT_REGISTRY) -> DataFrame:
    """Stored scores computed by another registry version."""
    return scores.filter(f"engine_version <> '{registry.version}'")
