"""Feature registry, thresholds and physical-plan policy, all as plain data."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field, replace

from wonted.functions.domains import DEFAULT_SUFFIXES, SuffixRules

DAY = 86400

# Feature name, weight at raw = 1.0, group.  The order is the order of the score sum.
FEATURES = (
    ("lookalike_domain", 25.0, "identity"),
    ("display_name_collision", 25.0, "identity"),
    ("auth_fail", 15.0, "identity"),
    ("reply_to_divergence", 10.0, "identity"),
    ("embedded_addr_mismatch", 10.0, "identity"),
    ("attachment_type_novelty", 15.0, "behavioral"),
    ("first_attachment_ever", 10.0, "behavioral"),
    ("link_domain_novelty", 10.0, "behavioral"),
    ("send_hour_anomaly", 8.0, "behavioral"),
    ("link_density_anomaly", 5.0, "behavioral"),
    ("size_anomaly", 5.0, "behavioral"),
    ("dormant_resurrection", 5.0, "behavioral"),
    ("cold_attachment", 12.0, "cold"),
    ("cold_links", 6.0, "cold"),
    ("cold_replyto", 8.0, "cold"),
)

# Label of each trust tier.
TIER_LABELS = {
    0: "never seen",
    1: "sender new, organization known",
    2: "prior one-way contact",
    3: "established two-way correspondence",
}

# Allowed members of the enumerated columns.
DIRECTIONS = ("in", "out")
FOLDER_ROLES = ("inbox", "sent", "archive", "other")
AUTH_METHODS = ("oauth2", "app_password", "mail_store")

# Mailbox names that count as inbox / sent, best candidate first.
INBOX_NAMES = ("[Gmail]/All Mail", "INBOX")
SENT_NAMES = ("Sent Messages", "[Gmail]/Sent Mail", "Sent Items", "Sent")


@dataclass(frozen=True)
class Registry:
    """Weights and thresholds of the scoring rules, and the public-suffix rules behind every registrable domain.

    ``version`` is stored with every score, so a changed registry makes old scores detectable.  Give the same
    registry to every step, from landed rows to reports.
    """

    version: str = "1.0.0"
    weights: dict = field(default_factory=lambda: {n: w for n, w, _ in FEATURES})
    min_baseline: int = 8
    confidence_k: int = 10
    lookalike_min_len: int = 6
    name_min_len: int = 4
    dormant_gap: int = 90 * DAY
    dormant_multiple: int = 6
    size_z: tuple = (2.5, 6.5)
    size_std_floor: float = 0.35
    links_z: tuple = (2.0, 6.0)
    links_std_floor: float = 1.0
    hour_alpha: float = 0.5
    one_way_messages: int = 2
    one_way_span: int = 7 * DAY
    max_score: float = 100.0
    max_text_bytes: int = 1024 * 1024
    listing_default: int = 200
    listing_max: int = 1000
    suffixes: SuffixRules = DEFAULT_SUFFIXES

    def changed(self, **changes) -> Registry:
        """A registry with other weights or thresholds and a version stamp derived from them."""
        weights = {**self.weights, **changes.pop("weights", {})}
        new = replace(self, weights=weights, **changes)
        digest = hashlib.sha256(repr(replace(new, version="")).encode()).hexdigest()[:8]
        return replace(new, version=f"{self.version}+{digest}")


DEFAULT_REGISTRY = Registry()


@dataclass(frozen=True)
class SkewPolicy:
    """When and how one key's rows are split over several tasks.

    Keys with more than ``hot_rows`` rows are listed and broadcast.  There are fewer than rows / ``hot_rows`` of
    them; where that could exceed ``listed_keys``, the threshold rises to rows / ``listed_keys``, so the list is
    never cut.  Results never depend on it.  A lookup table counted to have at most ``broadcast_rows`` rows is
    broadcast.
    """

    hot_rows: int = 2_000_000
    chunk_rows: int = 500_000
    id_block: int = 1 << 19
    listed_keys: int = 1_000_000
    sample_target: int = 50_000_000
    broadcast_rows: int = 200_000


DEFAULT_SKEW = SkewPolicy()
