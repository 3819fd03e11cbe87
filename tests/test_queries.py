"""Named queries against their SQL on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import check  # noqa: E402

import __spark_entry__ as entrypoint  # noqa: E402

SAMPLE = [
    "agg6_recall_profile", "agg10_condition_recall", "evt2_event_rows", "win6_score_runs",
    "src5_budgeted_ingest", "snk1_publish_read_back", "smp5_quota_cap", "jn8_slot_overlay",
    "smp7_balanced_pool", "aud2_recut_segments", "aud7_augmentation_plan", "aud4_mix_at_snr",
    "smp13_cyclic_batches", "agg11_stress_summary", "agg18_condition_report", "win8_margin_verdict",
    "src9_npy_scan", "smp17_choose_candidate", "agg13_interference_only", "src6_storage_keys",
    "src7_ingest_report", "snk5_config_hash", "agg2_pool_job", "agg15_condition_mean_recall",
    "agg17_condition_wins", "agg18_leaderboard", "udtf_refractory_events", "smp9_custom_injection",
    "ml1_score_windows",
]


@pytest.fixture(scope="module")
def con(sf_dir):
    return check.connect(sf_dir)


NAMES = list(entrypoint.oracle_sql()) if os.environ.get("EARSHOT_ALL_QUERIES") else SAMPLE


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, sf_dir, name):
    verdict = check.compare(spark, con, name, sf_dir)
    assert verdict.startswith("ok") and "TYPES" not in verdict, verdict


def test_every_sql_has_a_query():
    assert set(entrypoint.oracle_sql()) <= set(entrypoint.queries())


def test_entry(spark):
    assert entrypoint.entry(spark).count() == 32
