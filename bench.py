"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default all) choose
data and threads. Each query is run whole into a no-op sink, so every row and
column is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidewatt.plans.registry import load_catalog  # noqa: E402
from tidewatt.session import build_session  # noqa: E402

HEADLINE = [
    "clean_panel_coverage",
    "panel_scan",
    "hour_spine",
    "lag_week_exact",
    "lag_validate",
    "dedup_last",
    "source_fill",
    "panel_audit",
    "missing_blocks",
    "lag_rows_24",
    "trailing_mean_24",
    "lookback_sequences",
    "holiday_flag",
    "wavg_strict",
    "wavg_renorm",
    "topk_stations",
    "sheet_to_load",
    "merge_parts_coalesce",
    "area_long_std",
    "pivot_last",
    "html_links",
    "month_coverage",
    "lag_missing_reason",
    "xtab_hour",
    "forecast_metrics",
    "metrics_by_month",
    "metrics_overlap",
    "error_histogram",
    "model_rank",
    "fit_ridge",
    "fit_additive",
    "fit_seasonal_by_region",
    "incremental_merge",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "*")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": os.environ.get("BENCH_SHUFFLE", str(os.cpu_count() or 8)),
            "spark.ui.enabled": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
            "spark.log.level": "ERROR",
        },
    )
    catalog = load_catalog()
    spark.read.parquet(f"{folder}/events.parquet").count()
    chosen = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in chosen:
        begin = time.perf_counter()
        catalog[name].plan(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
