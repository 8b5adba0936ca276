"""Time the headline queries; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["top_suspected", "top_indicators", "call_history", "daily_report", "validate_reports", "audit", "dedup_exact", "near_duplicates", "risk_scores",
            "chunk_probabilities", "metrics_by_group", "rising_alerts", "keep_newest", "cascade_delete"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from ringwarden.plans.catalogue import QUERIES
    from ringwarden.session import build_session

    spark = build_session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    QUERIES[HEADLINE[0]](spark, sf).write.format("noop").mode("overwrite").save()  # code is compiled and files are met once
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf)}))
    spark.stop()


if __name__ == "__main__":
    main()
