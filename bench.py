"""Times the headline queries; prints one JSON line."""

import json
import os
import time

from lotlens.plans.registry import QUERIES
from lotlens.session import session

HEADLINE = ["comparable_price_ref", "dealer_market_ref_basis", "price_context_cuts", "price_track", "weekly_market_stats", "days_to_gone", "opportunity_score", "match_with_reasons", "red_flags_ordered", "duplicate_pairs_mutual", "demand_levels", "stock_alert_scan", "upsert_merge", "as_of_join", "north_star_weekly", "market_rollup", "pricing_summary", "fair_value_curve"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", spark__master=f"local[{cpus}]", spark__driver__memory="12g", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # the JVM is warm
    took = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
