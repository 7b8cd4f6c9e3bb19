"""Times the headline queries and prints one JSON line.

Reads ``BENCH_SF_DIR`` (default /root/testdata/sf0.1) on ``local[BENCH_CPUS]``.
Every query runs over whole tables into a no-op sink.  Before the timed pass each
query runs once on the smallest tables, so that the JVM and the code generator
are warm; the timed pass includes planning.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from catalog import registry  # noqa: E402
from docweir.session import local_session  # noqa: E402

HEADLINE = [
    "zone_fields_td1", "repair_field", "map_by_rules", "ground_exact", "merge_fields", "needs_review",
    "cascade_summary", "redact_text", "redaction_report", "pii_signals_documents", "norm_for_grounding",
    "contamination", "running_spend", "budget_gate", "key_health", "cache_lookup", "usage_rollup",
    "latency_quantiles", "extraction_metrics", "apply_corrections", "retention_sweep", "render_text",
    "parse_subject_table", "ood_decision", "filter_amount_words",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "docweir-bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    names = sys.argv[1:] or HEADLINE
    small = str(Path(sf_dir).parent / "sf0.001")
    warm = small if Path(small).exists() else sf_dir
    took = {}
    for name in names:
        queries[name](spark, warm).write.format("noop").mode("overwrite").save()
    for name in names:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_total_seconds", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "sf": sf_dir.rstrip("/").split("sf")[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
