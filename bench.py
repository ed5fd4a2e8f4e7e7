"""Times the headline queries on one machine and prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--driver-memory 8g pyspark-shell")

from textloom.plans import catalog, corpus, scripts  # noqa: E402, F401
from textloom.session import session  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINES = (
    "catalog_sync", "lines_exploded", "line_search", "visible_text", "markup_only_filter", "tag_signature_multiset", "keyword_profile", "slug_keys_deduped",
    "exact_match_pairs", "normalized_match", "tiered_match_best", "superseded_anti", "file_full_outer", "set_diff_references", "overlay_coalesce", "partial_stats",
    "carry_forward_flag", "continuation_islands", "greedy_batches", "running_offset", "fuzzy_blocked_levenshtein", "sequence_similarity", "masked_code",
    "extract_literals", "lint_scripts", "reference_drift", "build_guard",
)
RUNS = 3


def main() -> None:
    spark = session("bench", CPUS, **{"spark.sql.shuffle.partitions": CPUS, "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINES:
        times = []
        for _ in range(RUNS):  # the first run compiles code; the median counts
            began = time.perf_counter()
            catalog.QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(sorted(times)[RUNS // 2], 4)
    print(json.dumps({"metric": "sum of median seconds of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": FOLDER.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
