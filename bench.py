"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

from acclaim.session import build_session
from acclaim.testing.queries import all_queries

HEADLINE = [
    "candidate_records", "sentence_split_docs", "sentence_recover", "marker_hits_greedy", "author_mentions", "year_mentions",
    "reference_parse_bracket", "doc_dedup_first", "lexicon_counts_docs", "works_by_title", "verify_contains", "register_global_no",
    "reading_order", "line_islands", "batch_summary", "progress_windows",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "acclaim-bench", master=f"local[{cpus}]",
        **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    all_queries()["batch_summary"](spark, sf_dir).collect()  # start the JVM's work outside the timings
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        begin = time.time()
        all_queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - begin, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
