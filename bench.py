"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]
and print ONE JSON line with per-query wall seconds.

Each query is fully executed with the ``noop`` sink (every column of every
row is produced, nothing is collected to the driver).  A warm-up run of a
small query absorbs JVM start-up."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "R3_sponsor_performance_top20",
    "R1_status_distribution",
    "R8_dataset_overview",
    "R16_univariate_panel",
    "B2_load_summary_all_tables",
    "B3_column_profile_submissions",
    "B8_value_distributions_applications",
    "C2_C3_C4_clean_submissions",
    "T1_approval_time_stats",
    "T2_monthly_series",
    "T3_series_features",
    "Z2_chi_square_priority_vs_approval",
    "Z3_mann_whitney_priority_faster",
    "Z4_gini_sponsor_concentration",
    "P1_P2_risk_scores",
    "P4_readiness_top20",
    "P5_sponsor_success_top20",
    "P7_dose_decile_approval",
    "M2_M3_approval_features",
    "M15_sponsor_features",
    "M23_drug_recommendations_top5",
    "M24_isolation_forest_applications",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from regula.plans.registry import QUERIES, load_all
    from regula.session import get_session
    spark = get_session(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2, app_name="regula-bench")
    load_all()
    QUERIES["R1_overall_approval_rate"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for key in HEADLINE:
        t0 = time.perf_counter()
        QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[key] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
