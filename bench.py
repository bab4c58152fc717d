"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from dossier import catalog

QUERIES = (
    "list_leads_page", "list_leads_deep_page", "list_leads_without_phone", "list_leads_search", "facets_classification", "facets_source", "dashboard_totals", "source_yield",
    "coverage_by_geo", "source_pair_overlap", "distinct_identifier_collapse", "survivorship_trust_recency", "pair_score_noisy_or", "resolve_tombstones", "lead_scores",
    "extract_emails", "canonical_urls",
)


def main() -> None:
    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in QUERIES:
        runs = []
        for _ in range(3):
            t = time.perf_counter()
            catalog.queries()[name](spark, d).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t)
        took[name] = round(statistics.median(runs), 3)
    spark.stop()
    print(json.dumps({"metric": "read_model_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(d.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
