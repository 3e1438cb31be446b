"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from riskfeat.plans.catalog import BOOK  # noqa: E402

HEADLINE = [
    "party_totals", "type_summary", "pivot_flows", "aggregate_by_key", "inner_join_named_keys", "restrict_to_parties",
    "counterparties", "lookback_features", "offset_pairs", "residual_flow", "top_values_per_group", "row_ids",
    "feature_profile", "population_report", "quantiles", "correlation_matrix", "histogram", "fill_median",
    "weight_of_evidence", "iv_summary", "iv_sweep", "entropy_woe", "area_under_curves", "clean_text", "word_frequency",
    "token_report", "texts_with_phrase", "phrase_table_hits", "fuzzy_tokens", "fuzzy_words_of_texts", "payment_accounts",
    "undirected_edges", "downsampled_sizes", "upsampled_sizes", "nearest_neighbours",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("riskfeat-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    BOOK["type_summary"].run(spark, folder).collect()
    times: dict[str, float] = {}
    for name in wanted:
        start = time.perf_counter()
        BOOK[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr)
    spark.stop()
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
