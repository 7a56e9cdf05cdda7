"""Times the headline queries: one JSON line. BENCH_SF_DIR, BENCH_CPUS."""

import json
import os
import re
import time

from pyspark.sql import SparkSession

HEADLINES = ("q01_term", "q03_prefix", "q05_fuzzy_transpositions", "q07_phrase", "q10_span_near", "s06_term_top10", "s08_boolean_top10", "c03_dismax", "c06_nested", "k05_top_by_field", "k06_collapse", "k09_range_sorted", "a01_facet_counts", "a04_range_facets", "p01_parsed_boolean", "v01_nearest_cosine", "g02_completions", "t14_invert")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from siftwell import queries

    took = {}
    start = time.perf_counter()
    queries.snapshot(spark, sf_dir)
    took["index_build"] = round(time.perf_counter() - start, 3)
    for name in HEADLINES:
        runs = []
        for _ in range(3):
            start = time.perf_counter()
            queries.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        took[name] = round(sorted(runs)[1], 3)
    sf = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({"metric": "sum of medians of three runs, index build once", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf[1]) if sf else None}))
    spark.stop()


if __name__ == "__main__":
    main()
