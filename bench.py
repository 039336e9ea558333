"""Time the headline queries: one JSON line on stdout.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores. Each query
is run once to warm up on the smallest tables and then timed once, all rows computed and discarded.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "failed_login_sources", "window_counts_5m", "tumbling_hits", "brute_force_sources", "fanout_sources", "builtin_web_rules", "findings_full",
    "access_log_roundtrip", "json_access_roundtrip", "iis_roundtrip", "mixed_formats", "db_log_roundtrip", "waf_log_roundtrip", "app_log_roundtrip",
    "audit_roundtrip", "windows_xml_roundtrip", "shell_history_rows", "correlated_scores", "attack_chains", "source_stats", "timeline",
    "baseline_downrank", "ioc_hits", "geo_first_match", "ip_enrichment", "script_signals", "entropy", "redacted_text", "ip_classes", "sarif_results",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from tracelight.plans import all_queries
    from tracelight.session import build_session

    spark = build_session("bench", master=f"local[{cpus}]", shuffle_partitions=cpus, spark__ui__enabled="false",
                          spark__ui__showConsoleProgress="false", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("OFF")
    registry = all_queries()
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(small):
        registry["access_log_roundtrip"].run(spark, small).write.format("noop").mode("overwrite").save()
    timings: dict[str, float] = {}
    for name in names:
        started = time.perf_counter()
        registry[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - started, 3)
        print(name, timings[name], file=sys.stderr, flush=True)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings,
                      "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
