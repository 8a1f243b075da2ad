"""Headline queries at one scale; prints one JSON line.

    BENCH_SF_DIR   folder of the tables, default /root/testdata/sf0.1
    BENCH_CPUS     local cores, default 8
    BENCH_RUNS     timed runs per query after one warm-up, default 3

Every query is run to the end through the no-op sink, so all its rows are made
and none are collected. The figure per query is the median of its runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cairngeo.plans.catalogue import QUERIES  # noqa: E402
from cairngeo.session import local_session  # noqa: E402

HEADLINE = (
    "P2_bbox_filter",
    "P3_intersects_box",
    "A1_match_count",
    "O1_feature_page",
    "A21_table_stats",
    "J12_points_in_boxes",
    "J12_points_in_diamonds",
    "A20_map_tiles",
    "F6_metric_to_degrees",
    "F2_wkb_to_geojson",
    "J9_layers_due",
    "A7_order_totals",
    "A8_dominant_type",
    "A10_delivery_totals",
    "J7_transfer_plan",
    "A13_update_check",
    "A5_delivery_bounds",
    "F9_tile_polygons",
    "W1_latest_per_train",
    "F24_weather_rows",
    "A18_points_per_node",
    "F28_point_colour",
    "T1_live_trains",
    "P12_readonly_sql",
    "J13_user_joins",
    "S3_layer_ingest",
    "K1_publish_layer",
    "K5_publish_orders",
    "K6_publish_incremental",
)


def run(spark, sf_dir: str, name: str) -> float:
    begin = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begin


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cpus)
    seconds = {}
    for name in HEADLINE:
        run(spark, sf_dir, name)
        seconds[name] = round(statistics.median(run(spark, sf_dir, name) for _ in range(runs)), 3)
    line = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir).removeprefix("sf"),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
