"""Time the headline queries and print one JSON line.

BENCH_SF_DIR  tables to read (default /root/testdata/sf0.1)
BENCH_CPUS    local executor threads (default 8)

Every query is run to the end with the ``noop`` sink, once to warm the JVM and
once timed.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fleetlens.plans.catalogue import QUERIES  # noqa: E402

HEADLINE = (
    "row_multiset_digest",
    "lineitem_multiset_digest",
    "verify_tables",
    "table_diff",
    "sample_checksum",
    "keyed_records_digest",
    "verify_keyed",
    "open_incidents",
    "link_remediation",
    "check_sla",
    "missed_checks",
    "counter_delta",
    "telemetry_rollup",
    "top_processes",
    "audit_verdicts",
    "host_software",
    "redact_secrets",
    "normalize_ddl",
    "chunk_digests",
    "provenance_match",
    "catchup_status",
    "fence_violations",
    "suppress_within_ttl",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("fleetlens-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    times = {}
    for name in names:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
