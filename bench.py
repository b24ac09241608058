"""Times the catalog at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]`` and prints one JSON
line. ``python bench.py name ...`` times only the named queries."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "m1_basic_metrics", "m2_dtype_summary", "m3_quality_score", "m4_numeric_summary",
    "m5_feature_types", "c1_drop_incomplete", "c2_mean_fill", "c3_median_fill",
    "c4_mode_fill", "c5_knn_impute", "c7_drop_duplicates", "c8_iqr_flags",
    "c9_zscore_flags", "c10_isolation_forest", "c12_invalid_tokens",
    "c14_standardize_text", "c17_label_encode", "c18_factorize", "c20_min_max",
    "c21_standard", "g1_rule_suggestions", "g3_parse_replies", "g5_auto_clean",
    "b3_report_comparison", "i1_distributions", "i2_correlations", "i3_categories",
    "i4_trend", "i5_top_insights", "v3_correlation_matrix", "v4_distributions",
    "v8_daily_series", "s1_load_csv",
)


def main(names):
    from pyspark.sql import SparkSession

    from catalog import QUERIES

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start the JVM's and the Python workers' machinery outside the timings.
    spark.range(1000).mapInPandas(lambda it: it, "id bigint").groupBy("id").count().collect()
    spark.read.parquet(f"{folder}/nation.parquet").count()
    times = {}
    for name in names or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
