"""Times the headline queries: one JSON line on standard output. The first query runs once before, untimed, so that start-up is not counted as its own."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from dossierflow.plans import catalog  # noqa: E402
from dossierflow.session import build_session  # noqa: E402

HEADLINE = (
    "A5_category_counts", "C2_classify", "W1_mark_duplicates", "A3_J4_dedup_stats", "A8_W3_name_clusters", "A9_object_groups", "A10_X10_people",
    "A18_merge_entities", "A7_cost_grouping_sets", "A12_entity_rollup", "J7_J8_scan_state", "J10_broken_links", "F5_skip_reasons", "F21_search",
    "S12_X28_invoices", "W8_X34_chunks", "X12_redact", "X30_html_text", "C5_C6_model_answers", "T2_throttle",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    queries = catalog.QUERIES
    run = lambda name: queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    run(HEADLINE[0])
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        run(name)
        took[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
