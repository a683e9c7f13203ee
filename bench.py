"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

from sitefold.plans import catalog
from sitefold.session import build_session

HEADLINE = (
    "enrich_full",
    "enrich_with_responses",
    "crawl_frontier",
    "html_markdown",
    "page_contacts",
    "domain_context",
    "lead_heuristic",
    "leader_search_fill",
    "provider_fallback",
    "llm_validate",
    "links_top_k",
    "html_links",
    "emails_extract",
    "emails_extract_documents",
    "overview_sentences",
    "cost_totals",
    "report_flat",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "sitefold-bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.registered()
    # Start the engine (JVM code, Python workers) on a small scale first, so that the
    # first query timed does not carry the start-up of all.
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    for name in ("enrich_with_responses", "links_top_k") if os.path.isdir(warm_dir) else ():
        queries[name](spark, warm_dir).write.format("noop").mode("overwrite").save()

    seconds = {}
    for name in names:
        start = time.perf_counter()
        # every result column of every row is computed; nothing is sent to the driver
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
