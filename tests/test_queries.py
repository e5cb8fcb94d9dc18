"""The entry points; a choice of named queries against DuckDB (tests/compare.py runs all)."""

from pathlib import Path

import pytest
from compare import compare, duck

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
CHOICE = (
    "auth_fail", "embedded_addr_mismatch", "prior_state", "first_uses", "value_counts", "reply_credits",
    "trust_activations", "trust_tier_current", "normalize_address", "link_domains", "emails_in_text", "osa_distances",
    "header_facts", "parsed_messages", "contiguous_prefix", "folder_selection", "account_detection", "status_counts",
)

needs_data = pytest.mark.skipif(not Path(SMALL).exists(), reason="no test tables")


def test_every_query_has_a_counterpart():
    from wonted.plans.queries import QUERIES

    assert set(QUERIES) <= set(entry.queries()) and set(QUERIES) <= set(entry.oracle_sql())


@needs_data
@pytest.mark.parametrize("name", CHOICE)
def test_query(spark, name):
    assert compare(entry.queries()[name](spark, SMALL), duck(SMALL), entry.oracle_sql()[name]) is None


@needs_data
def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and rows[0]["anomaly_score"] >= rows[-1]["anomaly_score"]
