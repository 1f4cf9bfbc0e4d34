"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one warm-up of each, then the
median of three runs that force the full result. Prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from clickloom.plans.queries import QUERIES
from clickloom.session import get_session

HEADLINE = ["area_top3_product", "page_convert_rate", "session_filtered", "session_bucket_ratio", "session_sample", "category_counts", "top10_session", "ad_province_top3", "ad_click_trend", "ad_blacklist_filter"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(statistics.median(runs[1:]), 3)
    print(json.dumps({"metric": "total of headline queries, median of 3", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "spark": spark.version, "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
