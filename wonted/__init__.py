"""Behavioural baselines and explainable as-of anomaly scoring for message tables on Spark."""

from wonted.config import DEFAULT_REGISTRY, TIER_LABELS, Registry, SkewPolicy

__all__ = ["DEFAULT_REGISTRY", "TIER_LABELS", "Registry", "SkewPolicy"]
