"""Benchmark of the headline queries; prints one JSON line.

Reads $BENCH_SF_DIR (default sf0.1) on local[$BENCH_CPUS].  Every query runs twice and writes
its whole result to a sink that discards it; the second run counts, when code is compiled
and Python workers wait.
"""

from __future__ import annotations

import json
import os
import time

from catalogue import entries
from session import make_session
from tablewise.operators import clean, health, pii, profile
from tablewise.operators.correlate import correlation_matrix

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")


def headline(spark):
    def table(name):
        return spark.read.parquet(f"{SF_DIR}/{name}.parquet")

    named = entries()

    def query(name):
        return lambda: named[name].run(spark, SF_DIR)

    return {
        "health_score_lineitem": lambda: health.health_score(table("lineitem")),
        "health_score_dirty_orders": query("p15_health_score"),
        "missing_summary_lineitem": lambda: profile.missing_summary(table("lineitem")),
        "outliers_lineitem": lambda: profile.outlier_summary(table("lineitem")),
        "distribution_lineitem": lambda: profile.distribution_summary(table("lineitem")),
        "cardinality_lineitem": lambda: profile.cardinality_summary(table("lineitem")),
        "dedupe_lineitem": lambda: clean.drop_duplicates(
            table("lineitem"), ["l_orderkey", "l_linenumber"], order_by=["l_partkey"]
        ).df,
        "fill_median_lines": query("c01b_fill_median"),
        "fill_forward_events": query("c01e_fill_forward"),
        "cap_outliers_lines": query("c04_cap_outliers"),
        "zscore_lines": query("c15_zscore"),
        "replay_orders": query("c21_replay"),
        "replay_chain_lines": query("c21_replay_chain"),
        "pearson_lineitem": lambda: correlation_matrix(table("lineitem")),
        "spearman_lineitem": query("p06_spearman_complete"),
        "spearman_all_lineitem": query("p06_spearman_all_columns"),
        "pii_detect_documents": lambda: pii.detect_pii(table("documents")),
        "pii_scrub_documents": query("i08_scrub_documents"),
        "pii_mask_customers": query("i07_synthetic"),
    }


def main():
    spark = make_session("bench")
    spark.read.parquet(f"{SF_DIR}/nation.parquet").groupBy("n_regionkey").count().collect()
    seconds = {}
    for name, build in headline(spark).items():
        for _ in range(2):
            start = time.perf_counter()
            build().write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall clock",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
