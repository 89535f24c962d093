"""Headline timings on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line, also when it is stopped.

Stage tables are timed where they are built (``stage_*``); the queries after them read the written
tables, as the jobs do. Every other entry computes its whole result and writes it to a no-op sink.
"""

from __future__ import annotations

import json
import os
import signal
import tempfile
import threading
import time

from basketlake.plans.catalogue import QUERIES
from basketlake.plans.workspace import workspace
from basketlake.session import build_session

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
# All entries end by then: one that still runs is cancelled, and it and those left out are named.
LIMIT = float(os.environ.get("BENCH_LIMIT", "1500"))

STAGES = ("clean", "split", "prices", "popular", "churn_features", "churn_table", "clv_table",
          "rolling_table", "events", "sequence_table")
HEADLINE = (
    "b1_exact_duplicates", "b6_outlier_flags", "b9_cleaning_summary", "c7_customer_split",
    "d2_tfidf", "e13_engagement_score", "feature_table_at_churn_cutoff",
    "e22_clv_features_at_cutoff", "f3_rolling_clv_dataset", "f7_rolling_sequences",
    "f8_padded_scaled_sequences", "f11_next_category_targets", "g1_rfm_describe",
    "g4_country_summary", "g9_correlation_matrix", "j4_item_neighbours", "j6_recommendations",
    "j7_offline_evaluation", "l1_latest_prediction", "l6_monthly_revenue",
    "l8_retention_priority", "l13_revenue_forecast", "h6_churn_logistic_regression",
    "h7_churn_decision_tree", "h19_value_ridge_log1p", "h29_anomaly_scores", "i3_silhouette",
    "f10_purchase_within_30_days", "h8_churn_random_forest", "h26_next_category_model",
    "d3_svd_embeddings", "h10_churn_linear_svm", "h11_churn_feed_forward", "h21_value_tweedie",
    "k1_value_tree_importance", "k1_churn_permutation_importance", "k5_partial_dependence",
    "h5_grid_search", "h22_value_hurdle", "h20_value_boosted_log1p", "l12_batch_scoring",
    "h31_held_out_evaluation", "h9_churn_boosted_depth", "h9_churn_boosted_leaves",
    "h20_value_boosted_squared_error", "i1_kmeans_search", "i2_mixture_search",
    "d4_taxonomy_candidates", "h24_value_cross_validation")


def main() -> None:
    spark = build_session("bench", f"local[{CPUS}]", {
        "spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false",
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "20g"),
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-", dir="/tmp")})
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    timings: dict[str, float] = {}
    failed: dict[str, str] = {}
    space = workspace(spark, FOLDER)
    asked = [(f"stage_{stage}", lambda s=stage: getattr(space, s)) for stage in STAGES]
    asked += [(name, lambda n=name: QUERIES[n](spark, FOLDER).write.format("noop").mode("overwrite").save())
              for name in HEADLINE]
    begun = time.perf_counter()

    def work() -> None:
        for name, action in asked:
            left = LIMIT - (time.perf_counter() - begun)
            if left < 1:
                return
            started = time.perf_counter()
            try:
                action()
                if time.perf_counter() - begun < LIMIT:
                    timings[name] = round(time.perf_counter() - started, 3)
            except Exception as error:  # noqa: BLE001
                failed[name] = f"{type(error).__name__}: {str(error)[:200]}"

    def report(*_) -> None:
        print(json.dumps({
            "metric": "total_seconds", "value": round(sum(timings.values()), 3), "unit": "sec",
            "queries": dict(timings), "sf": FOLDER.rstrip("/").rsplit("sf", 1)[-1], "failed": dict(failed),
            "not_ended": [n for n, _ in asked if n not in timings and n not in failed]}), flush=True)
        os._exit(0)  # a fit may still run in the worker thread

    signal.signal(signal.SIGINT, report)
    signal.signal(signal.SIGTERM, report)
    worker = threading.Thread(target=work, daemon=True)
    worker.start()
    while worker.is_alive() and time.perf_counter() - begun < LIMIT:
        worker.join(1)
    report()


if __name__ == "__main__":
    main()
