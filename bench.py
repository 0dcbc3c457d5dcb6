"""Wall time of the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

HEADLINE = ["ledger_coverage", "two_hop_pairs", "sibling_pairs", "cross_completeness", "co_membership", "reachable_states", "shortest_setup", "bounded_impact_3hop", "truth_table", "interval_gap_sweep", "cov_guard", "bm25_topk", "cosine_topk", "rrf_fuse", "asof_state", "model_diff", "drift_3way", "exposure_bands", "validation_findings", "generated_pairs", "evidence_candidates", "link_proposals", "check_chains", "synthesised_transitions", "search_conversations", "pairwise_cases"]


def main() -> None:
    from pyspark.sql import SparkSession

    from statewake.plans import registry

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    found, seconds = registry.queries(), {}
    registry.flagship(spark, sf_dir).count()  # starts the session's code
    for name in HEADLINE:
        began = time.time()
        found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, wall time", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
