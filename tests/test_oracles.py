"""Registered queries against their SQL on the smallest tables.

A cross-section runs by default; ``LEDGERLIGHT_ALL=1`` runs every query.
"""

import os

import pytest

import __spark_entry__ as entry
from compare import connect, difference
from paths import SF_DIR

from ledgerlight.plans.oracles import ORACLES
from ledgerlight.plans.registry import QUERIES

CORE = [
    "telemetry_hourly", "review_daily", "cost_daily", "histogram_quantiles", "in_flight", "top_agent_days", "call_pairs",
    "chain_verify_tampered", "chain_root", "canonical_numbers", "match_rules", "decide_calls", "evaluate_responses", "session_features", "anomaly_flags", "incidents",
    "evidence_packets", "account_summary", "neighbours_2_hop", "structuring_check", "sample_stats", "screen_best", "assess",
    "judge_scenarios", "cluster_outliers", "merged_latency", "rejected_transfers", "alert_bundles", "in_windows", "expand_by_count",
]
NAMES = list(ORACLES) if os.environ.get("LEDGERLIGHT_ALL") else CORE


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    assert difference(entry.queries()[name](spark, SF_DIR), duck, entry.oracle_sql()[name]) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
