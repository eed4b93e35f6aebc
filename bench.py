"""Times the headline queries, the median of BENCH_REPEATS (default 3) runs each. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (names, default
the list below; 'all' runs every query).
"""
import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))
HEADLINE = [
    "latest_per_key", "current_offers", "best_per_tier", "price_summary", "same_tier_spread",
    "seller_order", "tier_deals", "best_deal_and_runner_ups", "comparison_matrix", "similar_entities",
    "cluster_runs", "consecutive_misses", "offer_availability", "price_history", "history_matrix",
    "price_moves", "price_drops", "observed_index", "swing_gate", "snapshot_after", "run_health",
    "price_compare", "sanity_flags", "best_matches", "best_matches_per_seller", "best_matches_wide",
    "best_replacement", "coverage_cut", "offers_from_products", "offers_from_html",
    "offers_from_datalayer", "promo_signals", "attributes_from_html", "document_outline",
    "broken_internal_links", "reconcile", "upsert_mapping", "replace_by_key", "link_state",
    "recovery_pass_events", "read_observations", "monthly_index", "planting_windows",
]


def main():
    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from gate import registry

    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(registry.QUERIES) if wanted == "all" else wanted.split() or HEADLINE
    registry.QUERIES["active_only"](spark, sf_dir).collect()  # start the JVM side before timing
    timings = {}
    for name in names:
        runs = []
        for _ in range(REPEATS):
            start = time.perf_counter()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        timings[name] = round(statistics.median(runs), 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(name, timings[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
