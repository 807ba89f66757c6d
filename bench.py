"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

import contextlib
import importlib
import json
import os
import sys
import time

HEADLINE = [
    "review_summary", "top_users", "tied_top_users", "avg_rating_by_city", "city_avg_two_aggregates", "partition_profile_custom", "date_customer_baskets",
    "frequent_itemsets", "frequent_pairs", "pcy_pairs", "son_frequent_itemsets", "minhash_signatures", "lsh_similar_pairs", "pearson_pairs", "cf_predictions", "cf_rmse",
    "features4", "features14", "hybrid_predictions", "hybrid_model_predictions", "sentiment_stars", "label_propagation", "connected_components", "bloom_fpr", "flajolet_martin", "reservoir",
    "tumbling_counts", "cluster_summary", "mahalanobis_assign", "kmeans_fixed_init",
    "op1_decontamination", "op2_warc", "op3_toxicity", "op4_lm_scoring", "op5_sharding", "op6_minhash_near_dedup", "op7_language_id", "op8_html_extraction", "op9_fingerprints", "op10_mixing",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    with contextlib.redirect_stdout(sys.stderr):
        from pyspark.sql import SparkSession

        spark = (
            SparkSession.builder.master(f"local[{cpus}]").appName("bench")
            .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
            .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
            .getOrCreate()
        )
        spark.sparkContext.setLogLevel("ERROR")
        queries = importlib.import_module("__spark_entry__").queries()
        spark.range(1000).selectExpr("sum(id)").collect()
        seconds, failed = {}, {}
        for name in [n for n in sys.argv[1:] or HEADLINE if n in queries]:
            started = time.time()
            try:
                queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
                seconds[name] = round(time.time() - started, 3)
            except Exception as error:  # a failure is reported, not hidden
                failed[name] = f"{type(error).__name__}: {str(error)[:200]}"
        spark.stop()
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    out = {"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}
    print(json.dumps(out | ({"failed": failed} if failed else {})))


if __name__ == "__main__":
    main()
