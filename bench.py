"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The claim tests run the published setting: 10,000 permutations of 1,500 rows per claim.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from evidenta.operators import resampling as R
from evidenta.plans import catalog
from evidenta.plans.views import table

HEADLINE = (
    "period_change", "margins", "variance_decomposition", "concentration", "pareto", "segment_ranking", "outliers_period", "outliers_row",
    "seasonality_calendar", "seasonality_rolling", "incomplete_last_period", "price_volume_mix", "segment_growth", "customer_view", "rfm",
    "profile_numeric", "column_roles", "rollup_panel", "histogram", "spearman", "spearman_matrix", "cliffs_delta", "epsilon_squared",
    "kendall_tau_b", "chi_square", "scan_correlation", "perm_stratified", "bh_qvalues", "gate_outcomes", "attack_subgroups", "attack_trim",
    "check_share", "lesson_topk", "forecast_backtest", "trend_differenced", "leakage_lint", "anomalies",
)


def claims(spark: SparkSession, sf: str) -> dict:
    rows = table(spark, sf, "customer").orderBy("c_custkey").limit(1500)
    parts = rows.withColumn("low", (F.col("c_nationkey") < 12).cast("string"))
    return {
        "claim_correlation_10000": lambda: R.fast_rank_test(rows, "c_nationkey", "c_acctbal", 10_000).collect(),
        "claim_group_10000": lambda: R.fast_rank_test(parts, "low", "c_acctbal", 10_000, kind="group", reference="true").collect(),
    }


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    every = catalog.queries()
    spark.range(10).selectExpr("sum(id)").collect()
    every["period_change"](spark, sf).collect()  # compiles and warms the scan
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        began = time.perf_counter()
        every[name](spark, sf).collect()
        seconds[name] = round(time.perf_counter() - began, 3)
    for name, run in claims(spark, sf).items():
        began = time.perf_counter()
        run()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
