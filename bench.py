"""Time the headline queries. Prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
The customer profile is built first and timed as ``profile_build``; the reports then read it, as a user's
session would. Each query runs once to warm up and then BENCH_RUNS times (default 2); the median is reported.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

from tenora.catalog import load  # noqa: E402
from tenora.plans.profile import customer_profile, profile  # noqa: E402
from tenora.session import build_session  # noqa: E402

HEADLINE = [
    "cluster_stats", "churn_retention_rate", "churn_score_threshold", "status_by_cluster", "cltv_by_status",
    "demographics_overview", "city_profile", "contract_distribution", "contract_impact", "internet_type_by_cluster",
    "services_adoption", "top_service_combos", "combo_churn_rate", "charges_overview", "revenue_efficiency",
    "tenure_charge_correlation", "top_revenue_focus", "payment_distribution", "payment_metrics_focus",
    "satisfaction_overview", "satisfaction_correlation", "satisfaction_by_tenure_group_focus", "charges_correlation",
    "numeric_distributions", "numeric_outliers", "describe_numeric", "describe_text", "customer_bins",
    "line_statistics", "line_correlation_by_flag", "order_price_percentiles", "median_order_per_customer",
    "event_type_share_per_user", "merge_insert_only", "merge_upsert", "keyed_update", "table_locations",
    "table_customer_info", "table_customer_contract", "landing_types", "landing_typed_rows", "anova_f_values",
    "cluster_spread_metrics", "silhouette_squared", "segmented_embeddings", "segmentation_search", "row_ids", "sampled_rows", "normalised_round_trip",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory="16g", spark__sql__files__maxPartitionBytes="16m",
    )
    spark.sparkContext.setLogLevel("ERROR")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    catalog = load()
    times: dict[str, float] = {}

    def timed(build) -> float:
        start = time.perf_counter()
        run(build())
        return time.perf_counter() - start

    run(customer_profile(spark, sf_dir))
    times["profile_build"] = round(statistics.median(timed(lambda: customer_profile(spark, sf_dir)) for _ in range(runs)), 4)
    run(profile(spark, sf_dir))
    for name in HEADLINE:
        build = catalog[name].build
        timed(lambda: build(spark, sf_dir))
        times[name] = round(statistics.median(timed(lambda: build(spark, sf_dir)) for _ in range(runs)), 4)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": Path(sf_dir).name.removeprefix("sf"), "cpus": int(cpus), "runs": runs,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
