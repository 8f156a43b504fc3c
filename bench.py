"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from braid.catalog import load  # noqa: E402
from braid.session import build_session  # noqa: E402

HEADLINE = [
    "velocity_1h_24h_30d",
    "fraud_features",
    "score_and_decide",
    "attribution_top4",
    "next_best_action",
    "whatif_borderline",
    "apply_changes",
    "stream_velocity",
    "landscape_wide",
    "board_global",
    "board_region_alloc",
    "alias_match",
    "trial_resolved",
    "definitions_applied",
    "publication_gap",
    "shred_trials",
    "chunk_sections",
    "articles_flatten",
    "term_index",
    "bm25_topk",
    "cosine_topk",
    "hybrid_rrf",
    "question_route",
    "global_rank",
    "entitled_rows",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 1))
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    # One small query first, so that starting the JVM is not charged to a query.
    queries["decision_mix"](spark, sf_dir.replace("sf0.1", "sf0.001") if "sf0.1" in sf_dir else sf_dir).collect()
    times: dict[str, float] = {}
    for name in names:
        begin = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - begin, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
