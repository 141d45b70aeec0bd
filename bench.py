"""Time the headline queries: one warm-up and one timed run each, results not collected.

Prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from eventloom.catalog import QUERIES  # noqa: E402
from eventloom.session import local_session  # noqa: E402

HEADLINE = [
    "event_weight", "signature_match", "signature_candidates", "attach_observations", "event_groups",
    "event_nodes", "event_edges", "unified_nodes", "unified_stats", "doc_event_match", "doc_event_clusters",
    "actor_sequence", "node_upsert", "edge_upsert", "graph_stats", "graph_hash", "temporal_precedes",
    "entity_resolution", "equivalence_sets", "weighted_relationships", "keyword_filter", "url_dedup",
    "circuit_breaker", "paragraph_dedup", "content_budget", "citation_exact", "vector_topk", "hmac_verify",
    "profile_grouping_sets", "collected_entries",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "eventloom-bench", **{"spark.sql.shuffle.partitions": cpus if cpus != "*" else "8"})
    took: dict[str, float] = {}
    for name in only:
        for _round in ("warm-up", "timed"):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries, second run",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
