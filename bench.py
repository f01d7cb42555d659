"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from verilens.plans.catalog import QUERIES
from verilens.session import build, release

HEADLINE = [
    "eer_by_label", "verification_metrics", "det_curve", "cosine_trials", "mixing_metrics", "csbg_lexical", "transition_counts",
    "llr_scores", "evaluation_run", "lexicon_build", "label_merge", "fused_scores", "configurations", "attack_cells", "fit_policy",
    "operating_point", "cluster_bootstrap", "integrity_audit", "exact_dups", "throttle_wait", "challenge_consume", "series_snr",
    "answer_match", "repetition_loop", "stratified_split", "poc_protocol",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build("bench", f"local[{cpus}]", **{
        "spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": cpus, "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    QUERIES["tokenise"](spark, sf).limit(1).collect()  # start the JVM's compilers before the clock
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        release(spark)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"), "cpus": int(cpus), "shuffle_partitions": int(cpus)}))


if __name__ == "__main__":
    main()
