"""Time the headline queries and print one JSON line.

BENCH_SF_DIR: folder of tables (default sf0.1); BENCH_CPUS: local cores (default 8); BENCH_QUERIES: comma-separated
names, or `all`. Each query writes to Spark's no-op sink, so all columns of all rows are computed."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fieldspark.registry import load_all  # noqa: E402
from fieldspark.session import build_session  # noqa: E402

HEADLINE = (
    "river_discharge gap_ladder hourly_centred composite_latest composite_series mask_coast apply_weights idw_weights interpolate_track "
    "locate_points section_sample edge_neighbours node_to_element sigma_to_z shared_scale encode_scale plan_records extract_points "
    "score_by_lead resolve_source byte_ranges publish_gate archive_days latest_issue search_catalog rank_donors select_gauges "
    "resample_hourly index_runs coverage_strip stream_hourly nearest_site"
).split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "")
    every = load_all()
    chosen = HEADLINE if not names else list(every) if names == "all" else names.split(",")
    spark = build_session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    # One small job first, so the first query does not pay for starting the engine.
    every["quality_rollup"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in chosen:
        start = time.perf_counter()
        every[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name:24s} {seconds[name]:8.3f}", file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
