"""Times the headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from millrace.plans import registry
from millrace.session import session

HEADLINE = ("revenue_by_state", "freight_ratio_by_category", "monthly_revenue", "weekend_vs_weekday", "top_categories", "delivery_days_by_state", "seller_state_revenue", "order_size_distribution", "qoq_growth", "cancelled_value_by_month", "clean_full", "scd1", "scd2", "scd3", "fact_orders_pit", "scd_price_vs_current", "naive_vs_pit_revenue")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    took = {}
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # warm the JVM
    began = time.perf_counter()
    registry.build(spark, sf_dir)
    took["build_star"] = round(time.perf_counter() - began, 3)
    for name in HEADLINE:
        began = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total time of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
