"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the local cores.  Each query runs
twice and the better time counts, so that compiling the first plan is not measured.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))

from alertloom.session import build_session  # noqa: E402
from checks.queries import QUERIES  # noqa: E402

HEADLINE = (
    "top_listings", "page_elements", "page_text", "url_join", "pipe_anchor_listings", "extract_cards",
    "extract_wordpress", "extract_json_ld", "extract_rss", "default_rules", "term_matches", "relevance", "score",
    "infer_date", "parse_date", "best_per_key", "collapse_url_company", "rank_topn", "rank_documents", "anti_seen",
    "digest_messages", "request_plan_all", "lane_plan_pages", "url_policy_pages", "source_breakdown", "date_check",
    "seen_prune", "ttl_dedupe", "alert_run_batch", "extract_many_cards", "extract_loose_feeds", "page_errors", "seen_versions",
    "funnel", "incremental_alerts",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(min(runs), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": Path(sf_dir).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
