"""Registered queries against their SQL on the smallest tables."""

from pathlib import Path

import pytest

from pitspark.plans import catalogue
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"
# One or two of every family; `python tests/oracle.py` runs all of them.
SAMPLE = (
    "feature_snapshot", "asof_strict", "asof_inclusive", "articles_per_bar", "event_within_24h", "bar_article_slots",
    "rolling_z", "atr_14", "macd_signal", "time_rolling_mean", "yoy_mom", "table_fingerprint", "html_articles", "source_preference",
    "validate_nulls", "vis_next_session", "event_calendar", "feature_category", "latest_revision", "tercile_thresholds",
    "walk_forward_folds", "label_triple_barrier", "pos_donchian", "metrics_bundle", "raps_quantile", "adaptive_ece", "sizer",
    "bar_anchor_stats", "v2_variance_ratio_8", "cursor_ingest",
)

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_query(spark, con, name):
    ok, message, _ = compare(spark, con, name, SF)
    assert ok, message


def test_every_query_has_a_check_or_a_reason():
    rows_only = set(catalogue.QUERIES) - set(catalogue.ORACLES)
    assert rows_only == {
        "calibration_report", "file_integrity", "group_ablation", "permutation_importance", "pos_linear", "pos_tree", "sharpe_bootstrap", "vol_state_posterior",
    }
