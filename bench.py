"""Wall seconds of the headline queries: prints one JSON line.

``BENCH_SF_DIR`` is the data folder (default sf0.1), ``BENCH_CPUS`` the number of local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from logquarry import build_session  # noqa: E402
from logquarry.bridge import Bridge  # noqa: E402
from logquarry.plans import load  # noqa: E402

HEADLINE = [
    "parse_syslog_header", "parse_firewall_csv", "parse_generic_syslog", "classify_events", "classify_by_registry",
    "normalize_cloud_events", "parse_line_timestamps", "columnize_syslog", "apply_columnizers",
    "text_search", "text_search_documents", "term_search", "regex_search", "classify_severity", "failure_lines",
    "already_blocked", "unified_search", "geo_enrich", "geo_enrich_distinct", "match_alert_rules", "match_line_rules",
    "mark_analyzed", "dedup_new_events", "flow_aggregates", "flow_map_points", "daily_trend", "ingest_rate_5m",
    "prune_by_cap", "tail_bytes", "number_lines", "analysis_batches", "build_prompts", "clean_replies", "chunk_lines",
    "pack_token_budget", "top_k_all_sources", "alert_gate_batch", "stream_dedup",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    plans = load()
    wanted = sys.argv[1:] or HEADLINE
    bridge = Bridge(spark, folder)
    plans["list_events"].run(bridge).write.format("noop").mode("overwrite").save()  # start-up is not measured
    seconds = {}
    for key in wanted:
        started = time.perf_counter()
        plans[key].run(Bridge(spark, folder)).write.format("noop").mode("overwrite").save()
        seconds[key] = round(time.perf_counter() - started, 3)
    scale = folder.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "total_wall_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
