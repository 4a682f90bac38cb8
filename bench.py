"""Wall time of the headline queries; prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8) choose data
and cores, ``BENCH_ONLY`` a comma-separated part of the queries. Every query is written to the no-op sink, twice; the better time counts, so the
one-off cost of compiling generated code is left out.
"""

from __future__ import annotations

import json
import os
import time

from checks.registry import QUERIES
from quillwatch.session import build_session

HEADLINE = (
    "decisions",
    "scan_summary",
    "rule_report",
    "deduplicated_alerts",
    "lifecycle_states",
    "batch_merge",
    "log_replay",
    "incidents_from_events",
    "incidents_from_intervals",
    "incident_members",
    "incident_assessment",
    "recommendations",
    "feedback_verdicts",
    "request_rates",
    "request_pressure",
    "throttle",
    "hold_rule",
    "audit_chain_intact",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    chosen = os.environ.get("BENCH_ONLY", "")
    for name in chosen.split(",") if chosen else HEADLINE:
        best = None
        for _ in range(2):
            started = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            spent = time.perf_counter() - started
            best = spent if best is None else min(best, spent)
        times[name] = round(best, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
