"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from libsight import session  # noqa: E402
from libsight.plans import QUERIES  # noqa: E402

HEADLINE = (
    "reading_clock", "page_dwell", "daily_rhythm", "item_reading_summary", "reading_streak",
    "continue_reading", "annotation_matrix", "annotation_page_heat", "parent_resolution", "tag_tree",
    "citation_gaps", "top_gaps", "gap_citations", "citation_edges", "shared_tag_links",
    "note_backlinks", "venue_rank", "library_view", "review_deck", "new_findings", "history_budget",
    "bm25_scores", "lexical_search", "semantic_search", "hybrid_search", "chunk_text", "strip_html",
    "quote_anchors", "cached_translate", "reference_ingest",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session.build("libsight-bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    chosen = sys.argv[1:] or HEADLINE
    QUERIES["palette_counts"](spark, folder).collect()  # start the engine before timing
    times = {}
    for name in chosen:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
