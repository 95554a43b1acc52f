"""Time the headline queries and print one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the data and the number of cores.  Every
query is executed completely into Spark's no-op sink; nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

#: Query and the table whose rows it works through.
HEADLINE = {
    "endpoint_verdicts": "events",
    "firewall_verdicts": "lineitem",
    "normalize_firewall_lines": "lineitem",
    "parse_csv_lines": "events",
    "alert_suppression": "lineitem",
    "window_pass_rows": "lineitem",
    "correlate_all": "lineitem",
    "analyze_all": "events",
    "process_creation_tree": "lineitem",
    "profile_log_formats": "events",
    "hunt_top_blocked_sources": "lineitem",
}


def main() -> None:
    from logwarden.plans import registry
    from logwarden.session import local_session

    global SF_DIR
    spark = local_session(cores=CPUS, shuffle_partitions=int(CPUS), app="logwarden-bench")
    # The test tables are single files that one task reads.  Tables of a cluster come in many files, so they are
    # first written that way, before anything is timed.
    many = tempfile.mkdtemp(prefix="bench-")
    for t in set(HEADLINE.values()):
        spark.read.parquet(f"{SF_DIR}/{t}.parquet").repartition(2 * int(CPUS)).write.parquet(f"{many}/{t}.parquet")
    small = os.path.join(os.path.dirname(SF_DIR.rstrip("/")), "sf0.001")
    scale, SF_DIR = os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"), many
    counts = {t: spark.read.parquet(f"{SF_DIR}/{t}.parquet").count() for t in set(HEADLINE.values())}
    # One run on the smallest data first: code generation and JIT compilation
    # cost the same at any scale and are not what is measured here.
    warmed = os.path.isdir(small) and os.environ.get("BENCH_WARM", "1") == "1"
    for name in HEADLINE if warmed else []:
        registry.QUERIES[name](spark, small).write.format("noop").mode("overwrite").save()
    seconds, rates = {}, {}
    for name, table in HEADLINE.items():
        start = time.perf_counter()
        registry.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        rates[name] = round(counts[table] / seconds[name])
        print(f"{name}: {seconds[name]} s", file=sys.stderr)
    print(json.dumps({
        "metric": "headline_queries_total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "rows_per_second": rates, "warmed": warmed,
        "sf": scale,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
