"""A spread of registered queries against their SQL twins on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.check_oracle import compare, duck

D = "/root/testdata/sf0.001"
SPREAD = ["s1_packages_load", "s6_lifecycle_items", "n5_logistic_processes", "n9_operators", "n11_planned_span",
          "p2_span_ratio", "p12_promise_used", "j2_itinerary_join", "j4_pair_rate_lookup", "a4_rates_by_pair",
          "a11_span_boxes", "a13_picking_histogram", "a22_correlations", "a29_packages_per_order", "w3_cv_blocks",
          "w7_event_gaps", "u1_new_categories", "m1_scaled_numbers", "m2_encoded_rows", "m9_calibration",
          "m4_feature_vector", "m4_rate_vector", "m5_prepared_splits", "p17_slot_names", "j1_event_join",
          "d5_retrain_decision", "s13_monitor_report", "e2_pr_auc", "d2_feature_drift", "x4_factor_texts", "st2_prediction_stream"]


@pytest.fixture(scope="module")
def con():
    return duck(D)


@pytest.mark.parametrize("name", SPREAD)
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, D, name, queries()[name], oracle_sql()[name]) == ""


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0


def test_every_twin_has_a_query():
    assert set(oracle_sql()) <= set(queries())
