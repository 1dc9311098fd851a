"""Headline queries at one scale. Prints one JSON line; per-query wall seconds, best of two runs after a warm session."""

from __future__ import annotations

import json
import os
import time
from tempfile import mkdtemp

from loomtrace.plans import registry
from loomtrace.session import local_session

HEADLINE = [
    "c13_state", "c14_resolutions", "c21_late_events", "d1a_threads", "d3a_summary", "d5a_trajectory_analysis",
    "j2_conversation_continuity", "b10_redaction", "b14_anchor_extraction", "f1_idempotent_ingest", "e1_identity_resolution",
    "e5_anchor_rescue", "e11_contrastive_pairs", "h04_structured_linker", "h19_route_decision", "k3_candidate_metrics",
    "k4_pairwise_clustering", "i1_work_states", "i4_structural_signals",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cores=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, checkpoint_dir=f"file://{mkdtemp()}")
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = registry.load(), {}
    for name in HEADLINE:
        best = None
        for _ in range(2):
            start = time.perf_counter()
            queries[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best or 1e9, time.perf_counter() - start)
        seconds[name] = round(best, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
