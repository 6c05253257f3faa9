"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from seguelake import queries as registry
from seguelake.session import local_session

HEADLINE = (
    "adjacency_pairs", "preference_lift", "mixability", "pair_rules", "candidate_pairs", "record_linkage", "asof_marker_join", "frame_interval_join",
    "dj_style_profile", "venue_profile", "canonical_tracks", "quantiles_by_group", "ranking_metrics", "rank_correlations", "contiguous_runs",
    "normalize_curve", "sequence_guardrails", "vector_knn_join", "decoy_pools", "dedupe_by_content", "text_keys", "comment_bursts",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    registry.load_all()
    # one unmeasured query starts the JVM's code paths
    registry.QUERIES["bpm_in_range"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.time()
        registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(
        json.dumps(
            {"metric": "headline queries, total wall time", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
