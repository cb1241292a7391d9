"""Time the headline queries once each and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from covermetrics.plans.registry import Book, all_plans
from covermetrics.session import build_session

HEADLINE = (
    "geo_risk_scorecard", "combined_ratio_by_tier", "loss_ratio_by_state", "portfolio_kpis", "premium_vs_claims_monthly",
    "customer_360", "agent_scorecard", "claims_by_region_month", "fraud_bands", "delinquency_by_month", "churn_features",
    "tier_drift_after_claim", "ledger_pivot", "dq_run_rules", "dq_table_scores", "dq_profile", "dq_column_health",
    "content_duplicates", "near_duplicates", "outliers_z", "forecast_linear", "scenario_grid", "pricing_segments",
    "claims_in_disaster_window", "cube_claims_matrix", "cube_crosstab", "chunk_fixed", "bm25_topk", "vector_topk",
    "intake_policies", "product_match_hybrid", "lexicon_sentiment", "upsert_policies", "allocate_vehicles",
    "activity_sessions", "stream_alert_windows",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g")})
    spark.sparkContext.setLogLevel("ERROR")
    plans = all_plans()
    book = Book(spark, folder)
    plans["claims_summary"].build(book).write.format("noop").mode("overwrite").save()  # start the JVM's engines
    times = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        plans[name].build(book).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
