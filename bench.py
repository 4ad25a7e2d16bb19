"""Times the headline queries: one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINES = [
    "analytics_overview", "publications_page_year_desc", "facets", "rankings_authors", "trends_institution", "quality_flags", "suggest", "search_prefix",
    "network_institution_edges", "network_author_edges", "researcher_landscape", "researcher_page_facts", "degree_strength", "merge_group", "dedup_exact",
    "tfidf_top_terms", "vector_topk", "per_class_prf", "drift_psi", "topic_slope", "upsert_snapshot", "missing_percent",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from scholarmill.registry import QUERIES

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["metadata"](spark, FOLDER).collect()  # starts the engine
    took = {}
    for name in HEADLINES:
        began = time.time()
        QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
