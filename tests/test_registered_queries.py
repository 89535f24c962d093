"""Registered queries against their SQL on the smallest test tables, when those are present."""

from __future__ import annotations

from pathlib import Path

import pytest

from tests.oracle_check import differences, duck

FOLDER = "/root/testdata/sf0.001"
CHECKED = (
    "a1_load_transactions", "a5_null_rates", "b6_outlier_flags", "b9_cleaning_summary",
    "c7_customer_split", "d2_tfidf", "d8_product_popularity", "feature_table_at_churn_cutoff",
    "e22_clv_features_at_cutoff", "f3_rolling_clv_dataset", "f7_rolling_sequences",
    "f11_next_category_targets", "g1_rfm_describe", "g9_correlation_matrix", "h3_quantile_folds",
    "h13_roc_auc", "h27_multiclass_metrics", "i4_davies_bouldin", "j6_recommendations",
    "k4_plain_language", "l8_retention_priority_filtered", "l11_batch_preparation")


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not present")
@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    from basketlake.plans.catalogue import ORACLES, QUERIES
    problem = differences(QUERIES[name](spark, FOLDER).toPandas(), duck(FOLDER).execute(
        ORACLES[name]).df())
    assert not problem or problem.startswith("types"), problem


def test_every_statement_has_a_query():
    from basketlake.plans.catalogue import ORACLES, QUERIES
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 150
